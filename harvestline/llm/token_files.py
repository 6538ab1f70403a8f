"""Token-id files, compressed by Re-Pair grammars, in ascending document order.

Texts are range-partitioned and sorted by document id, encoded, and packed into blocks
of about ``BLOCK_TOKENS`` ids of whole documents. In each block frequent pairs of ids
are replaced by nonterminals until none is left: first in rounds, which replace all pairs
at once that are frequent, don't overlap and are more frequent than those they would
overlap, and when a round gains little, pair by pair, the most frequent one first.
No pair reaches over the end of a document, so any document, and any stretch of one,
can be decoded alone.

A block is one row of a Parquet table, so it is written, split, compressed and read
like any other, on any store. Its columns are the format:

| column | content |
|---|---|
| shard, block, before | range partition, number in it, ids before the block in its shard |
| n_tokens, base | ids in the block; the first nonterminal |
| doc_ids, doc_tokens, doc_symbols | id, number of ids and number of symbols of each document |
| rules | little-endian uint32 pairs: what the nonterminals base, base + 1, ... stand for |
| lengths | little-endian uint32: into how many ids each nonterminal expands |
| width, symbols | bytes a symbol (2 or 4) and the symbols, little-endian |
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, new_folder
from .common import by_value, worker_cache

by_value(__name__)

END = 2
BLOCK_TOKENS = 1 << 19
# A rule costs 12 bytes and a use saves 2 to 4, so rarer pairs don't pay.
LEAST_USES = 6
# After a round that shortens the block by less than this share, pairs are replaced one by one.
LEAST_GAIN = 0.02
MAX_REMEMBERED = 600_000
# Characters of texts that are encoded together.
GROUP_CHARS = 1 << 21
STOPS = ".,"

# Letters, digits, punctuation and blanks that every Unicode version classes alike.
_ODD = re.compile(r"[^\n\x20-\x7e\u00a1-\u024f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u2013\u2014\u2018-\u201e\u2022\u2026\u20ac]")
# Where white space is more than one blank, and the mark of a special token.
_WHOLE = ("  ", "\n\n", " \n", "\n ", "<|")

BLOCK = (
    "shard int, block int, before long, n_tokens long, base long, doc_ids array<long>, doc_tokens array<long>, "
    "doc_symbols array<long>, rules binary, lengths binary, width int, symbols binary"
)


# --- encoding ----------------------------------------------------------------


def _laid_out(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, sizes) of parts, one after the other."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes, sizes


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Encoder:
    """The ids of a text as little-endian uint32.

    The pre-tokeniser of byte-level BPE cuts before a single blank or line feed, and
    BPE never merges over a cut. So a chunk of text from one such place to the next
    has the same ids wherever it stands, and the tokenizer sees each chunk once a
    worker. A text with any other white space, with signs beyond the common scripts,
    or with what may be a special token goes to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        # A sign that every byte-level vocabulary has as one id.
        self.stops = np.frombuffer(b"".join(self._encode(sign) for sign in STOPS), "<u4")
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocabulary = max(names.values()) + 1
        self.opens = np.zeros(self.vocabulary, bool)
        # How byte-level BPE writes a blank and a line feed in its ids' names.
        self.opens[[number for name, number in names.items() if name[0] in "\u0120\u010a"]] = True

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        # A chunk begins with the line feed that it was cut at, or the blank before it,
        # so in one run of chunks each starts where an id starts with one of these.
        asked = [chunk if chunk[:1] == "\n" else " " + chunk for chunk in chunks]
        found = self.tokenizer.encode_batch_fast(["".join(asked)], add_special_tokens=False)[0]
        ids = np.array(found.ids, "<u4")
        edges = (4 * np.flatnonzero(self.opens[ids])).tolist()
        if len(edges) != len(chunks):  # an id that holds more than its own start's blank
            return [self._encode(text) for text in asked]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(edges, [*edges[1:], len(raw)])]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of some texts, of bounded size together; what is new in them is learnt at once."""
        if len(self.known) > MAX_REMEMBERED:
            self.known.clear()
        odd = [self._is_odd(text) for text in texts]
        plain = iter(self._encode_plain([text for text, o in zip(texts, odd) if not o]))
        return [np.frombuffer(self._encode(text or ""), "<u4") if o else next(plain) for text, o in zip(texts, odd)]

    def _words(self, names: list[str]) -> list[bytes]:
        """Ids of distinct words, each as after a blank; those not known yet are learnt together."""
        parts = list(map(self.known.get, names))
        unknown = [i for i, part in enumerate(parts) if part is None]
        new = [names[i] for i in unknown]
        for i, part in zip(unknown, self._encode_chunks(new) if new else ()):
            parts[i] = part
        self.known.update((names[i], parts[i]) for i in unknown)
        return parts

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        """Each distinct word of the texts is looked up once, and ids are put together by its number."""
        if not texts:
            return []
        spaced = pa.array([text.replace("\n", " \n") for text in texts], pa.large_string())
        chunks = pc.split_pattern(spaced, " ")
        offsets, flat = chunks.offsets.to_numpy(), chunks.flatten()
        coded = flat.dictionary_encode()
        distinct = coded.dictionary
        # The pre-tokeniser also cuts between a word and its stop.
        last = pc.utf8_slice_codeunits(distinct, -1)
        bare = pc.utf8_slice_codeunits(distinct, 0, -1)
        ends = pc.utf8_is_alpha(pc.utf8_slice_codeunits(bare, -1))
        stop = np.zeros(len(distinct), np.int64)
        for i, sign in enumerate(STOPS, 1):
            stop[pc.and_(ends, pc.equal(last, sign)).to_numpy(zero_copy_only=False)] = i
        words = pc.if_else(pa.array(stop > 0), bare, distinct).dictionary_encode()
        if "" not in self.known:  # a blank at the end of a text
            self.known[""] = self._encode(" ")
        ids, starts, sizes = _laid_out(self._words(words.dictionary.to_numpy(zero_copy_only=False).tolist()))
        word = words.indices.to_numpy()
        # All distinct chunks: a word's ids and then its stop's one id.
        whole = sizes[word] + (stop > 0)
        until = np.cumsum(whole)
        laid = ids[np.minimum(_runs(starts[word], whole), max(len(ids) - 1, 0))]
        laid[until[stop > 0] - 1] = self.stops[stop[stop > 0] - 1]
        # A text's first chunk has no blank before it.
        firsts = flat.take(pa.array(offsets[:-1])).dictionary_encode()
        heads, head_starts, head_sizes = _laid_out([self._encode(head) for head in firsts.dictionary.to_pylist()])
        of = coded.indices.to_numpy().astype(np.int64)
        of[offsets[:-1]] = len(distinct) + firsts.indices.to_numpy()
        starts = np.concatenate((until - whole, len(laid) + head_starts))
        sizes = np.concatenate((whole, head_sizes))[of]
        found = np.concatenate((laid, heads))[_runs(starts[of], sizes)]
        return np.split(found, np.cumsum(sizes)[offsets[1:-1] - 1])

    @staticmethod
    def _is_odd(text: str | None) -> bool:
        """Whether the tokenizer has to see a text as a whole."""
        if not text or any(mark in text for mark in _WHOLE):
            return True
        return not _plain(text) or not text.isascii() and _ODD.search(text) is not None

    def __call__(self, text: str | None) -> bytes:
        return self.encode([text])[0].tobytes()


def _plain(text: str) -> bool:
    """Whether an ASCII text has no control sign but line feeds; others were looked at."""
    return not text.isascii() or text.replace("\n", "").isprintable()


# --- Re-Pair -----------------------------------------------------------------


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules) of a block of ids below ``base``; no pair holds the end id.

    In the symbols no pair is left that has ``LEAST_USES`` uses without overlap.
    """
    symbols, rules = _in_rounds(ids.astype(np.uint32), base)
    symbols, more = _one_by_one(symbols.astype(np.int64), base + sum(map(len, rules)))
    rules.append(np.array(more, np.int64).reshape(-1, 2))
    return symbols, np.concatenate(rules).astype(np.int64)


def _in_rounds(symbols: np.ndarray, following: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Replace many pairs at once, as long as a round gains much."""
    rules: list[np.ndarray] = []
    for turn in count():
        if len(symbols) < 2 * LEAST_USES:
            break
        bits = max(12, min(18, len(symbols).bit_length() - 1))
        left, right = symbols[:-1], symbols[1:]
        mixed = left * np.uint32(0x9E3779B1 + 2 * turn) ^ right * np.uint32(0x85EBCA77)
        slot = (mixed * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - bits)
        often = np.bincount(slot, minlength=1 << bits) >= LEAST_USES
        at = np.flatnonzero(often[slot] & (left != END) & (right != END))
        if not len(at):
            break
        # One pair has each slot of a table; pairs that lose it may have it next turn.
        slots, first, second = slot[at], left[at], right[at]
        owner = np.zeros((2, 1 << bits), np.uint32)
        owner[0, slots] = first
        owner[1, slots] = second
        able = (owner[0, slots] == first) & (owner[1, slots] == second)
        at, slots = at[able], slots[able]
        uses = np.bincount(slots, minlength=1 << bits)
        # Ranks of neighbours never tie, so chosen pairs never overlap.
        rank = np.zeros(len(symbols) + 1, np.int32)
        rank[at + 1] = np.where(uses[slots] >= LEAST_USES, 2 * uses[slots] + (at & 1), 0)
        own = rank[at + 1]
        best = (own > 0) & (own > rank[at]) & (own > rank[np.minimum(at + 2, len(symbols))])
        at, slots = at[best], slots[best]
        uses = np.bincount(slots, minlength=1 << bits)
        paying = np.flatnonzero(uses >= LEAST_USES)
        if not len(paying):
            break
        name = np.zeros(1 << bits, np.uint32)
        name[paying] = following + np.arange(len(paying))
        new = name[slots]
        at, new = at[new > 0], new[new > 0]
        rules.append(owner[:, paying].T)
        following += len(paying)
        before = len(symbols)
        symbols[at] = new
        keep = np.ones(before, bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        if before - len(symbols) < LEAST_GAIN * before:
            break
    return symbols, rules


def _one_by_one(symbols: np.ndarray, following: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Replace every frequent pair that is left, the most frequent one first.

    Where a pair stands is found once, for pairs that are frequent now; a rule makes new
    pairs only beside its uses, and all others only get rarer.
    """
    n = len(symbols)
    rules: list[tuple[int, int]] = []
    after, before, there = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
    where = _frequent(symbols)
    queue = [(-len(at), pair) for pair, at in where.items()]
    heapify(queue)
    while queue:
        uses, pair = heappop(queue)
        taken, free = [], -1
        for p in sorted(where.get(pair, ())):
            q = int(after[p])
            if p >= free and there[p] and q < n and symbols[p] == pair[0] and symbols[q] == pair[1]:
                taken.append(p)
                free = q + 1
        if len(taken) < LEAST_USES:
            where.pop(pair, None)
            continue
        if len(taken) < -uses:  # others may be more frequent by now
            where[pair] = taken
            heappush(queue, (-len(taken), pair))
            continue
        del where[pair]
        rules.append(pair)
        for p in taken:
            q = int(after[p])
            r = int(after[q])
            symbols[p], there[q], after[p] = following, False, r
            if r < n:
                before[r] = p
        fresh: dict[tuple[int, int], set[int]] = {}
        for p in taken:
            for one, two in ((int(before[p]), p), (p, int(after[p]))):
                if one >= 0 and two < n and symbols[one] != END and symbols[two] != END:
                    fresh.setdefault((int(symbols[one]), int(symbols[two])), set()).add(one)
        for new, at in fresh.items():
            if len(at) >= LEAST_USES:
                where[new] = list(at)
                heappush(queue, (-len(at), new))
        following += 1
    return symbols[there], rules


def _frequent(symbols: np.ndarray) -> dict[tuple[int, int], list[int]]:
    """Where the pairs stand that may have ``LEAST_USES`` uses; overlapping ones are all listed."""
    left, right = symbols[:-1].astype(np.uint64), symbols[1:].astype(np.uint64)
    pairs = left << np.uint64(32) | right
    slot = (pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)
    able = (np.bincount(slot.astype(np.int64), minlength=1 << 18) >= LEAST_USES)[slot]
    at = np.flatnonzero(able & (left != END) & (right != END))
    found, of, uses = np.unique(pairs[at], return_inverse=True, return_counts=True)
    at, of = at[uses[of] >= LEAST_USES], of[uses[of] >= LEAST_USES]
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    groups = np.split(at[order], cuts) if len(at) else []
    keys = found[uses >= LEAST_USES].tolist()
    return {(key >> 32, key & 0xFFFFFFFF): group.tolist() for key, group in zip(keys, groups)}


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Into how many ids each nonterminal expands; rules refer to earlier ones only."""
    lengths = np.ones(len(rules), np.int64)
    left, right = rules[:, 0] - base, rules[:, 1] - base
    while True:
        each = [np.where(side >= 0, lengths[np.maximum(side, 0)], 1) for side in (left, right)] if len(rules) else [lengths, 0]
        found = each[0] + each[1]
        if np.array_equal(found, lengths):
            return lengths
        lengths = found


def _flat(rules: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Expansions of all nonterminals, one after the other, and where each starts."""
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1].astype(np.int64)
    flat = np.repeat(np.arange(base, base + len(rules)), lengths)
    depth = np.arange(len(flat)) - np.repeat(starts, lengths)  # place within the symbol that stands there
    while True:
        open_at = np.flatnonzero(flat >= base)
        if not len(open_at):
            return flat, starts
        pair = rules[flat[open_at] - base]
        first = np.where(pair[:, 0] >= base, lengths[np.maximum(pair[:, 0] - base, 0)], 1)
        second = depth[open_at] >= first
        flat[open_at] = np.where(second, pair[:, 1], pair[:, 0])
        depth[open_at] -= np.where(second, first, 0)


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for."""
    if not len(rules):
        return symbols.astype("<u4")
    flat, starts = _flat(rules, lengths, base)
    inner = symbols >= base
    rule = np.where(inner, symbols - base, 0)
    size = np.where(inner, lengths[rule], 1)
    # Ids stand for themselves: a table of them after the expansions.
    table = np.concatenate((flat, np.arange(base)))
    origin = np.where(inner, starts[rule], len(flat) + symbols)
    ends = np.cumsum(size)
    return table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(origin - ends + size, size)].astype("<u4")


# --- files -------------------------------------------------------------------


def _block_row(shard: int, block: int, before: int, base: int, docs: list[int | None], parts: list[np.ndarray]) -> dict:
    ids = np.concatenate(parts)
    symbols, rules = compress(ids, base)
    ends = np.flatnonzero(symbols == END)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    return {
        "shard": shard,
        "block": block,
        "before": before,
        "n_tokens": len(ids),
        "base": base,
        "doc_ids": docs,
        "doc_tokens": [len(part) for part in parts],
        "doc_symbols": _symbols_per_document(ends, symbols, parts),
        "rules": rules.astype("<u4").tobytes(),
        "lengths": expansion_lengths(rules, base).astype("<u4").tobytes(),
        "width": width,
        "symbols": symbols.astype("<u2" if width == 2 else "<u4").tobytes(),
    }


def _symbols_per_document(ends: np.ndarray, symbols: np.ndarray, parts: list[np.ndarray]) -> list[int]:
    """Symbols of each document: up to its last end id, as a text may hold that id too."""
    inner = [np.count_nonzero(part == END) for part in parts]
    last = ends[np.cumsum(inner) - 1]
    return np.diff(np.concatenate(([-1], last))).tolist()


def _encoded(batches: Iterator[pa.RecordBatch], encode: Encoder) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, ids) of every row, encoded in groups of about ``GROUP_CHARS``."""
    docs: list[int | None] = []
    texts: list[str | None] = []
    size = 0
    for batch in batches:
        for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = value.as_py()
            docs.append(doc_id)
            texts.append(text)
            size += len(text or "")
            if size >= GROUP_CHARS:
                yield from zip(docs, encode.encode(texts))
                docs, texts, size = [], [], 0
    yield from zip(docs, encode.encode(texts))
    pa.default_memory_pool().release_unused()  # workers outlive the task, and other work shares their memory


def _packer(path: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("encoders")
        if path not in cache:
            cache[path] = Encoder(path)
        encode = cache[path]
        base = max(encode.vocabulary, END + 1)
        end = np.array([END], "<u4")
        shard = TaskContext.get().partitionId()
        schema = pa.schema(
            [("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("base", pa.int64())]
            + [(n, pa.list_(pa.int64())) for n in ("doc_ids", "doc_tokens", "doc_symbols")]
            + [("rules", pa.binary()), ("lengths", pa.binary()), ("width", pa.int32()), ("symbols", pa.binary())]
        )
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        held = before = block = 0

        def flush() -> pa.RecordBatch:
            row = _block_row(shard, block, before, base, docs, parts)
            return pa.RecordBatch.from_pylist([row], schema)

        for doc_id, ids in _encoded(batches, encode):
            part = np.concatenate((ids, end))
            docs.append(doc_id)
            parts.append(part)
            held += len(part)
            if held >= BLOCK_TOKENS:
                yield flush()
                before, block, held = before + held, block + 1, 0
                docs, parts = [], []
        if docs:
            yield flush()

    return pack


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text, each with the end id, in ascending order of id and text.

    ``tokenizer`` is the file of a tokenizer that every worker can open. A null or empty
    text is its end id alone. Null ids come first. Rows that repeat an id are all
    written, in order of their text. Other columns are not read. An empty table
    writes no blocks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(_packer(tokenizer), BLOCK).write.parquet(path)


def decode_block(row: dict, first: int = 0, until: int | None = None) -> list[np.ndarray]:
    """The ids of the documents ``first`` to ``until`` of a block; others are not expanded."""
    base = row["base"]
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2).astype(np.int64)
    lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
    cuts = np.concatenate(([0], np.cumsum(row["doc_symbols"]))).astype(np.int64)
    until = len(cuts) - 1 if until is None else until
    symbols = np.frombuffer(row["symbols"], "<u2" if row["width"] == 2 else "<u4")[cuts[first] : cuts[until]].astype(np.int64)
    ids = expand(symbols, rules, lengths, base)
    return np.split(ids, np.cumsum(row["doc_tokens"][first:until])[:-1])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            parts = decode_block(row)
            sizes = [len(part) for part in parts]
            starts = row["before"] + np.concatenate(([0], np.cumsum(sizes)))[:-1]
            crcs = [zlib.crc32(part.tobytes()) for part in parts]
            n = len(parts)
            arrays = [[row["shard"]] * n, row["doc_ids"], starts, sizes, crcs]
            kinds = [pa.int32(), *[pa.int64()] * 4]
            names = ["shard", "doc_id", "before", "n_tokens", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds)], names)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from its decoded ids."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per written partition
    starts = shards.select(F.col("shard").alias("of"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("at"))
    rows = blocks.mapInArrow(_unpack, "shard int, doc_id long, before long, n_tokens long, ids_crc32 long")
    placed = rows.join(broadcast_if_small(starts), F.col("shard") == F.col("of"))
    return placed.select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_index(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files of ``docs`` in the shared folder and give the index read from them."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = new_folder(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer)
    return read_index(docs.sparkSession, path)
