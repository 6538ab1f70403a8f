"""Fuzzy line dedup: one occurrence stays of each group of lines that hardly differ.

Lines are normalised to words, and equal ones are merged before they are shuffled. Each
distinct line gets a SimHash of its words, and is cut into overlapping blocks. A few
edits leave most blocks of a line whole (the pigeonhole principle), so lines meet on
equal blocks: all windows of ``WINDOW`` = 3 words, in lines of few words also the line
without one word, and in very short ones without one letter. Blocks of the line take
the place of blocks of the fingerprint's bits: lines at an edit similarity of 0.8 differ
in up to 15 of the 64 bits, where keys on bits are no longer selective.

Pairs that meet are checked on length, on ``FAR`` = 20 bits and on sharing a tenth of their
blocks (``SHARED``), short lines on length alone, and then on the edit similarity of the lines (at least 0.8 of the longer one),
with a banded Levenshtein distance. Groups are the connected components of what
is left. Where more than ``FULL_RUN`` lines share a block, they first meet
on it and one of four blocks of the fingerprint, which covers all within ``RADIUS`` = 3 bits.
Then all lines of the block that are in different groups by now are compared as any other pair is,
in slices of ``SLICE_LINES``, so that no pair is lost to a crowded block.

Blocks outweigh the text they come from, so they are made where a line's copies have met,
travel packed (four bytes of the key and two for the line), and those that a single line has
go no further.

Of the pairs of a line, the one with most blocks in common is verified first; the others are only
verified if that, over all lines, has left them apart. Where more than ``FULL_RUN``
lines share a block of both kinds, all are compared with one of them first; those that turn
out not to be linked to it are compared with all. Links among the others need no check:
they are one group already.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from . import common
from .common import by_value, column_of, free_name, keyed_runs, worker_cache
from .components import connected_components
from .decontamination import _NORMAL

by_value(__name__)

RADIUS = 3
FAR = 20
SIMILAR = 0.8
# Blocks that two lines must share, of those of the line that has more.
SHARED = 0.1
FULL_RUN = 128
WINDOW = 3
# The bits of a block's key.
KEY_BITS = 48
# Up to so many words, a line without one of its words is a block; up to so many letters, without one letter.
FEW_WORDS = 8
FEW_LETTERS = 24
# Lines of fewer letters than this have too few words for a telling fingerprint.
SHORT = 80
# Kinds of letters that are counted in these.
KINDS = 64
# Lines of a crowded block that are compared with as many others in one run.
SLICE_LINES = 2048
# The choices of one of RADIUS + 1 blocks of bits that a key can name.
CHOICES = 256
SEEDS = (42, 43, 44)
# Bytes of lines that a worker holds at a time.
SLICE_BYTES = 1 << 20
# Bytes of distinct lines whose blocks are dealt together, and how many lines at most.
PART_BYTES = 1 << 21
PART_LINES = 1 << 16
# Blocks that a bucket has on average, and bytes of text that have one block, about.
BUCKET = 1 << 19
BLOCK_BYTES = 6
# Bytes whose words are hashed at a time.
HASHED_BYTES = 1 << 18
# Pairs of texts whose distances are computed together, and the numbers that their tables may hold.
TOGETHER = 2048
TABLE = 1 << 22
# Lines of more letters than this are compared one pair after the other.
LONG = 1024
# Each bit of a byte in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# A number for each byte, none for a blank; the base of polynomials of them, and its inverse.
_LETTERS = np.random.default_rng(SEEDS[0]).integers(0, 1 << 64, 256, np.uint64) * (np.arange(256) != 32)
_BASE = 0xD6E8FEB86659FD95
_BACK = pow(_BASE, -1, 1 << 64)
# As for benchmark words, but line feeds stay.
_BY_LINE = _NORMAL[:10] + b"\n" + _NORMAL[11:]
_PLACE = "k1 long, k2 long, doc long, line long"
_LINE = f"{_PLACE}, n long, fp long, size int, norm binary"
# Rows that are dealt: the blocks of some lines in a bucket, a line, a line of a crowded block, such a block, and
# the marks of some lines.
CELL, NODE, HOT_LINE, HOT, MARKS = range(5)
_CELL = "bucket int, base long, keys binary, low binary, high binary, fps binary, sizes binary, blocks binary"
_RUN = "run long, key long, part int, other int, near int, node long, fp long, size int, root long, blocks int, letters binary, hot array<long>, weight array<int>"
_PAIRS = "a long, b long, run long, most int"
_DEALT = f"kind int, {_CELL}, {_PLACE}, node long, fp long, size int, of int, letters binary, key long, held long"



def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """:func:`common.staged`; the job's shuffle files, which are larger than the table, go as soon as it is written."""
    conf = df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, None)
    conf.set(DROP_SHUFFLES, "true")
    try:
        return common.staged(df, name, *partition_by)
    finally:
        conf.unset(DROP_SHUFFLES) if before is None else conf.set(DROP_SHUFFLES, before)


# --- lines and fingerprints ----------------------------------------------------


def normal_lines(text: str | None) -> Iterator[bytes]:
    """Lines as lower-case words, one blank between; digits and letters only."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_BY_LINE)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return (line.strip() for line in raw.split(b"\n"))


def fingerprints_of(lines: list[bytes]) -> np.ndarray:
    """SimHash of each line over its words, repeats included; lines must have words."""
    return _fingerprints(*_word_hashes(lines))


def _word_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all lines, in order, and the number of words of each line.

    A word's hash is a polynomial of its bytes, from sums over the bytes of many words.
    """
    data = np.frombuffer(b" ".join(lines) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    hashes = np.empty(len(ends), np.uint64)
    first, start = 0, 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, start + HASHED_BYTES)))
        some = data[start : ends[last - 1] + 1]
        if len(some) > HASHED_BYTES:  # a single word
            powers, inverse = _powers(_BASE, len(some)), _powers(_BACK, 1)
        else:
            powers, inverse = (_kept_powers(x)[: len(some)] for x in (_BASE, _BACK))
        sums = np.cumsum(_LETTERS[some] * powers)[ends[first:last] - start]
        sums[1:] -= sums[:-1].copy()
        sums[1:] *= inverse[ends[first : last - 1] + 1 - start]
        sums ^= sums >> np.uint64(32)
        sums *= np.uint64(0xD6E8FEB86659FD93)
        hashes[first:last] = sums ^ (sums >> np.uint64(29))
        first, start = last, int(ends[last - 1]) + 1
    return hashes, np.array([line.count(b" ") + 1 for line in lines])


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def _kept_powers(base: int) -> np.ndarray:
    cache = worker_cache("fuzzy_lines")
    if base not in cache:
        cache[base] = _powers(base, HASHED_BYTES)
    return cache[base]


def _fingerprints(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    # A byte of a hash is eight counters of eight bits, so up to 255 words are added at once.
    parts = -(-sizes // 255)
    firsts = np.cumsum(parts) - parts
    nth = np.arange(int(parts.sum())) - np.repeat(firsts, parts)
    cuts = np.append(np.repeat(np.cumsum(sizes) - sizes, parts) + 255 * nth, len(hashes))
    sums = np.empty((len(nth), 8), "<u8")
    step = 1 << 12  # parts at a time, so a long text needs no large array
    for first in range(0, len(nth), step):
        ends = cuts[first : first + step + 1]
        lanes = hashes[ends[0] : ends[-1]].astype("<u8").view(np.uint8).reshape(-1, 8)
        for lane in range(8):
            sums[first : first + step, lane] = np.add.reduceat(_SPREAD[lanes[:, lane]], ends[:-1] - ends[0])
    ones = np.add.reduceat(sums.view(np.uint8), firsts, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > sizes[:, None], axis=1, bitorder="little").view("<i8").ravel()


def blocks_of(lines: list[bytes], hashes: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Keys of the blocks of each line, see above, each once; lines with words only.

    All windows of all lines are blocks. Keys have ``KEY_BITS`` = 48 bits.
    """
    owners, keys = _blocks(lines, hashes, sizes)
    counts = np.bincount(owners, minlength=len(lines))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(keys.view(np.int64)))


def _blocks(lines: list[bytes], hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the line, key) of each block of each line, in order."""
    from xxhash import xxh64_intdigest

    spare = np.uint64(64 - KEY_BITS)
    owner = np.repeat(np.arange(len(lines)), sizes)
    inner = max(0, len(hashes) - WINDOW + 1)
    keys = np.zeros(inner, np.uint64)
    for i in range(WINDOW):
        keys = (keys ^ hashes[i : i + inner]) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    whole = owner[:inner] == owner[WINDOW - 1 :][:inner]
    owners, keys = [owner[:inner][whole]], [keys[whole]]
    for at in np.flatnonzero(sizes <= FEW_WORDS).tolist():
        line = lines[at]
        words = line.split()
        less = {line} | {b" ".join(words[:i] + words[i + 1 :]) for i in range(len(words))}
        letters = line.decode("utf-8", "replace")
        if len(letters) <= FEW_LETTERS:
            less |= {(letters[:i] + letters[i + 1 :]).encode("utf-8", "replace") for i in range(len(letters))}
        found = [xxh64_intdigest(x, SEEDS[1]) for x in less if x]
        owners.append(np.full(len(found), at))
        keys.append(np.array(found, np.uint64))
    owners, keys = np.concatenate(owners), np.concatenate(keys) >> spare
    found = []
    for first in range(0, len(lines), 1 << int(spare)):  # the number of a line and a key fit a number
        own = (owners >= first) & (owners < first + (1 << int(spare))) if len(lines) > 1 << int(spare) else slice(None)
        both = np.sort(((owners[own] - first).astype(np.uint64) << np.uint64(KEY_BITS)) | keys[own])
        both = both[np.concatenate(([True], both[1:] != both[:-1]))[: len(both)]]
        found.append(((both >> np.uint64(KEY_BITS)).astype(np.int64) + first, both & np.uint64((1 << KEY_BITS) - 1)))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _keys(line: bytes) -> tuple[int, int]:
    from xxhash import xxh64_intdigest

    return _signed(xxh64_intdigest(line, SEEDS[1])), _signed(xxh64_intdigest(line, SEEDS[2]))


def _scan(distinct: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places in _slices(batches):
            if distinct:
                seen: dict[bytes, list] = {}
                for line, doc, number in places:
                    held = seen.setdefault(line, [doc, number, 0])
                    held[2] += 1
                    # A null id comes after all others.
                    if (doc is None, doc or 0, number) < (held[0] is None, held[0] or 0, held[1]):
                        held[0], held[1] = doc, number
                rows = list(seen)
                columns = [*zip(*seen.values())]
                hashes, sizes = _word_hashes(rows)
                letters = [len(line.decode("utf-8", "replace")) for line in rows]
                more = [pa.array(_fingerprints(hashes, sizes)), pa.array(letters, pa.int32()), pa.array(rows, pa.binary())]
                names = ["k1", "k2", "doc", "line", "n", "fp", "size", "norm"]
            else:
                rows, *columns = zip(*places)
                more, names = [], ["k1", "k2", "doc", "line"]
            columns = [*zip(*map(_keys, rows)), *columns]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), *more], names)

    return scan


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, int | None, int]]]:
    """(line, doc, number) of all lines with words, about ``SLICE_BYTES`` of lines at a time."""
    held: list[tuple[bytes, int | None, int]] = []
    size = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for number, line in enumerate(normal_lines(text.as_py())):
                if line:
                    held.append((line, doc, number))
                    size += len(line)
                if size >= SLICE_BYTES:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _first_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First row of each (k1, k2) of a sorted partition, with the sum of the counts."""
    held: pa.RecordBatch | None = None
    total = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, n = (column_of(batch, c).to_numpy() for c in ("k1", "k2", "n"))
        starts = np.flatnonzero(np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))))
        sums = np.add.reduceat(n, starts)
        if held is not None:
            if (held.column(0)[0].as_py(), held.column(1)[0].as_py()) == (int(k1[0]), int(k2[0])):
                total += int(sums[0])
                starts, sums = starts[1:], sums[1:]
            if len(starts):
                yield _counted(held, np.array([total]))
                held = None
        if len(starts):
            if len(starts) > 1:
                yield _counted(batch.take(pa.array(starts[:-1])), sums[:-1])
            held, total = batch.slice(int(starts[-1]), 1), int(sums[-1])
    if held is not None:
        yield _counted(held, np.array([total]))


def _counted(rows: pa.RecordBatch, n: np.ndarray) -> pa.RecordBatch:
    at = rows.schema.get_field_index("n")
    columns = [pa.array(n, pa.int64()) if i == at else rows.column(i) for i in range(rows.num_columns)]
    return pa.RecordBatch.from_arrays(columns, rows.schema.names)


# --- candidate pairs -----------------------------------------------------------


def _masks() -> np.ndarray:
    """The bits of each of the four blocks of a fingerprint, one more than bits may differ."""
    width = 64 // (RADIUS + 1)
    return np.array([((1 << width) - 1) << (width * i) for i in range(RADIUS + 1)], np.uint64)


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a block of a line and a block of its fingerprint."""
    masks = _masks()
    # The lowest bits of a key are its choice, so that keys of two choices don't meet.
    salt = np.arange(len(masks), dtype=np.uint64)
    for batch in batches:
        blocks, nodes, fps = (column_of(batch, c).to_numpy() for c in ("key", "node", "fp"))
        mixed = (fps.view(np.uint64)[:, None] & masks[None, :]) ^ blocks.view(np.uint64)[:, None]
        for _ in range(2):
            mixed = mixed * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
        keys = (mixed & ~np.uint64(CHOICES - 1)) | salt[None, :]
        columns = [keys.ravel().view(np.int64), np.repeat(nodes, len(masks)), np.repeat(fps, len(masks))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "fp"])


def _may(fp: np.ndarray, size: np.ndarray, others: np.ndarray, sizes: np.ndarray, share: float) -> np.ndarray:
    """Which pairs of lines, by fingerprint and length, are near in both."""
    size, sizes = size[..., :, None], sizes[..., None, :]
    longest = np.maximum(size, sizes)
    near = np.abs(size - sizes) <= np.floor(longest * round(1 - share, 9))
    return near & ((longest < SHORT) | (np.bitwise_count(fp[..., :, None] ^ others[..., None, :]) <= FAR))


def _block_pairs(share: float):
    """Pairs of the lines of each block whose lengths and fingerprints are near.

    ``most`` is the number of blocks of the line that has more, and 0 for pairs of short lines.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, count, (_, *columns) in _whole_runs(batches, ["key", "node", "fp", "size", "blocks"]):
            yield from _run_pairs(starts, count, *columns, share)

    return pairs


def _cell_pairs(share: float):
    """:func:`_block_pairs` of the cells of each bucket."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _buckets(batches, ["base", "keys", "low", "high", "fps", "sizes", "blocks"]):
            key, *columns = _by_key(rows)
            cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            counts = np.diff(cuts)
            for count in np.unique(counts[counts > 1]).tolist():
                yield from _run_pairs(cuts[:-1][counts == count], count, *columns, share)

    return pairs


def _by_key(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """Keys, nodes, fingerprints, sizes and numbers of blocks of the cells of a bucket, by key."""
    bases, keys, low, high, *marks = zip(*rows)
    keys = np.frombuffer(b"".join(keys), np.uint32)
    order = np.argsort(keys)
    nodes = _nodes(bases, low, high)
    fps, sizes, blocks = marks
    return keys[order], nodes[order], np.frombuffer(b"".join(fps), np.int64)[order], *(_whole(c)[order] for c in (sizes, blocks))


def _halved(values: np.ndarray) -> bytes:
    """Numbers of four bytes, lower halves first: the upper ones are mostly 0, which compresses."""
    return values.astype("<i4").view("<u2").reshape(-1, 2).T.tobytes()


def _whole(values: tuple[bytes, ...]) -> np.ndarray:
    return np.concatenate([np.frombuffer(v, "<u2").reshape(2, -1).T.copy().view("<i4").ravel() for v in values])


def _nodes(bases: tuple[int, ...], low: tuple[bytes, ...], high: tuple[bytes, ...]) -> np.ndarray:
    """Lines of cells: two bytes, apart so that the upper ones compress, are added to each cell's first line."""
    nodes = np.frombuffer(b"".join(high), np.uint8).astype(np.int64) << 8 | np.frombuffer(b"".join(low), np.uint8)
    return nodes + np.repeat(np.array(bases, np.int64), [len(c) for c in low])


def _buckets(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, list[tuple]]]:
    """(bucket, rows) of each bucket of a partition sorted by bucket."""
    bucket, rows = None, []
    for batch in batches:
        for own, *row in zip(*(column_of(batch, c).to_pylist() for c in ["bucket", *names])):
            if own != bucket and rows:
                yield bucket, rows
                rows = []
            bucket = own
            rows.append(tuple(row))
    if rows:
        yield bucket, rows


def _run_pairs(
    starts: np.ndarray, count: int, node: np.ndarray, fp: np.ndarray, size: np.ndarray, blocks: np.ndarray, share: float
) -> Iterator[pa.RecordBatch]:
    step = max(1, (1 << 20) // (count * count))
    before = np.arange(count)[:, None] < np.arange(count)
    for low in range(0, len(starts), step):
        at = starts[low : low + step, None] + np.arange(count)
        near = _may(fp[at].view(np.uint64), size[at], fp[at].view(np.uint64), size[at], share) & before
        run, i, j = np.nonzero(near)
        x, y = at[run, i], at[run, j]
        most = np.where(np.maximum(size[x], size[y]) < SHORT, 0, np.maximum(blocks[x], blocks[y])).astype(np.int32)
        a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
        for first in range(0, len(x), 10_000):
            ends = [pa.array(c[first : first + 10_000]) for c in (a, b, most)]
            yield pa.RecordBatch.from_arrays([*ends[:2], pa.nulls(len(ends[0]), pa.int64()), ends[2]], ["a", "b", "run", "most"])


def _whole_runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[np.ndarray, int, list[np.ndarray]]]:
    """Starts of all runs of one length, that length, and the columns, of a partition sorted by the first column.

    Runs of one row are left out, and only a last run is held across batches.
    """
    held = None
    for batch in chain(batches, [None]):
        if batch is None:
            columns = held
        else:
            columns = [column_of(batch, c).to_numpy() for c in names]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
        if columns is None or not len(columns[0]):
            continue
        key = columns[0]
        cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        if batch is not None:
            held = [c[cuts[-2] :].copy() for c in columns]
            cuts = cuts[:-1]
        counts = np.diff(cuts)
        for count in np.unique(counts[counts > 1]).tolist():
            yield cuts[:-1][counts == count], count, columns


def _pairs(full_run: int):
    """Pairs within the radius of each key's lines; pairs with the first line of long runs.

    ``run`` is null but in long runs, where it is the key, for the rest of their links.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _masks().tolist()
        a: list = []
        b: list = []
        runs: list = []
        key, choice, nodes, fps, hub = None, 0, [], [], None

        def near(x: np.ndarray, y: np.ndarray, which: int) -> np.ndarray:
            apart = x[:, None] ^ y[None, :]
            own = np.bitwise_count(apart) <= RADIUS
            i, j = np.nonzero(own)
            first = np.ones(len(i), bool)
            for earlier in masks[:which]:  # the pair belongs to the first choice it meets on
                first &= (apart[i, j] & np.uint64(earlier)) != 0
            own[i, j] = first
            return own

        def close() -> None:
            if len(nodes) == 2 and hub is None:  # most keys that collide at all
                apart = fps[0] ^ fps[1]
                if apart.bit_count() <= RADIUS and all(apart & earlier for earlier in masks[:choice]):
                    a.append(nodes[0])
                    b.append(nodes[1])
                    runs.append(None)
            elif hub is None and len(nodes) > 2:
                marks = np.array(fps, np.uint64)
                left, right = np.nonzero(np.triu(near(marks, marks, choice), 1))
                a.extend(nodes[i] for i in left)
                b.extend(nodes[i] for i in right)
                runs.extend([None] * len(left))

        def out() -> pa.RecordBatch:
            columns = [*(pa.array(c, pa.int64()) for c in (a, b, runs)), pa.nulls(len(a), pa.int32())]
            batch = pa.RecordBatch.from_arrays(columns, ["a", "b", "run", "most"])
            for c in (a, b, runs):
                c.clear()
            return batch

        for batch in batches:
            columns = [column_of(batch, c).to_numpy() for c in ("key", "node", "fp")]
            same = columns[0][1:] == columns[0][:-1]
            matter = np.concatenate((same, [True])) | np.concatenate(([True], same))
            for k, node, fp in zip(*(column[matter].tolist() for column in columns)):
                if k != key:
                    close()
                    key, choice, nodes, fps, hub = k, k & (CHOICES - 1), [], [], None
                if hub is not None:
                    a.append(hub)
                    b.append(node)
                    runs.append(key)
                    continue
                nodes.append(node)
                fps.append(fp & 0xFFFFFFFFFFFFFFFF)
                if len(nodes) > full_run:
                    hub = nodes[0]
                    a.extend([hub] * full_run)
                    b.extend(nodes[1:])
                    runs.extend([key] * full_run)
            if len(a) > 10_000:
                yield out()
        close()
        yield out()

    return pairs


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``.

    A band of 2 * ``most`` + 1 diagonals goes column by column; its cells are the bits of
    integers (Hyyro's form of Myers' bit vectors), and equal ends are cut off before.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    start = _shared(a, b, False)
    a, b = a[start:], b[start:]
    end = _shared(a, b, True)
    a, b = a[: len(a) - end], b[: len(b) - end]
    most = min(most, len(a))
    if not b or most == 0 or most == len(a):
        return len(a) <= most
    width = 2 * most + 1
    whole, top = (1 << width) - 1, 1 << (width - 1)
    places: dict[str, int] = {}
    for at, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << at
    up, down = whole ^ ((1 << most) - 1), 0
    far, at_end = most, top >> 1
    limit = 2 * most + len(b) - len(a)
    for j, letter in enumerate(b):
        low = j - most
        same = places.get(letter, 0)
        same = (same >> low if low >= 0 else same << -low) & whole
        equal = ((((same & up) + up) ^ up) | same | down) & whole
        more = down | (whole ^ (equal | up))
        less = equal & up
        if j < len(a) - most:
            far += not equal & top
        else:
            far += bool(more & at_end) - bool(less & at_end)
            at_end >>= 1
        if far > limit:
            return False
        equal >>= 1
        up = less | (whole ^ (equal | more))
        down = equal & more
    return far <= most


def _shared(a: str, b: str, back: bool) -> int:
    """Letters that stand at the start, or end, of both, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        if (a[-half:] == b[-half:]) if back else (a[:half] == b[:half]):
            low = half
        else:
            high = half - 1
    return low


def all_within(xs: list[str], ys: list[str], most: list[int]) -> np.ndarray:
    """:func:`within` of each pair, for many pairs of about the same length at a time."""
    found = np.zeros(len(xs), bool)
    sized: dict[int, list[int]] = {}
    for at, (x, y) in enumerate(zip(xs, ys)):
        if max(len(x), len(y)) > LONG or not x or not y:
            found[at] = within(x, y, most[at])
        elif abs(len(x) - len(y)) <= most[at]:
            sized.setdefault(-(-min(len(x), len(y)) // 64), []).append(at)
    for words, places in sized.items():
        places.sort(key=lambda at: max(len(xs[at]), len(ys[at])))
        first = 0
        while first < len(places):
            some = places[first : first + TOGETHER]
            letters = len(set().union(*(xs[at] for at in some), *(ys[at] for at in some))) + 1
            some = some[: TABLE // (words * letters)]
            if len(some) < 16:
                some = places[first : first + 16]
                found[some] = [within(xs[at], ys[at], most[at]) for at in some]
            else:
                pairs = [sorted((xs[at], ys[at]), key=len) for at in some]
                found[some] = _together(*zip(*pairs), np.array([most[at] for at in some]), words)
            first += len(some)
    return found


def _together(xs: tuple[str, ...], ys: tuple[str, ...], most: np.ndarray, words: int) -> np.ndarray:
    """:func:`within` of pairs whose shorter line ``xs`` takes ``words`` numbers of 64 bits.

    Myers' bit vectors, a number for each 64 letters of ``xs``, column by column for all pairs.
    Pairs leave as soon as what is left of ``ys`` can't bring them within ``most``.
    """
    m, n = np.array([*map(len, xs)]), np.array([*map(len, ys)])
    flat = np.frombuffer("".join(xs + ys).encode("utf-32-le", "surrogatepass"), "<u4")
    places = np.zeros(int(flat.max()) + 1, np.int64)
    places[flat] = 1
    letters = int(places.sum()) + 1
    flat = np.cumsum(places)[flat]
    base = np.arange(len(xs)) * letters

    def columns(coded: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        table = np.zeros((len(sizes), int(sizes.max())), np.int64)  # 0 is no letter
        table[np.arange(table.shape[1]) < sizes[:, None]] = coded
        return np.ascontiguousarray((table + base[:, None]).T)

    cut = int(m.sum())
    equals = np.zeros((words, len(xs) * letters), np.uint64)
    for at, row in enumerate(columns(flat[:cut], m)):
        equals[at >> 6][row] |= np.uint64(1 << (at & 63))
    texts = columns(flat[cut:], n)
    end = ((m - 1) & 63).astype(np.uint64)
    up = [np.full(len(xs), ~np.uint64(0)) for _ in range(words)]
    down = [np.zeros(len(xs), np.uint64) for _ in range(words)]
    far, found, pairs = m.copy(), np.zeros(len(xs), bool), np.arange(len(xs))
    one, none, top, band = np.ones(len(xs), np.uint64), np.zeros(len(xs), np.uint64), np.full(len(xs), 63, np.uint64), int(most.max())
    across, more = np.empty_like(one), np.empty_like(one)
    for j in range(len(texts)):
        row, plus, minus = texts[j], one, none
        # Rows farther than ``most`` from the diagonal can't be on a way within it: above and below,
        # each cell is one more than the last, and ``far`` is the last row's so.
        lowest = min(words - 1, j + band >> 6)
        for w in range(max(0, j - band) >> 6, lowest + 1):
            equal, rises, falls = equals[w].take(row), up[w], down[w]
            below = equal | falls
            equal |= minus
            np.bitwise_and(equal, rises, out=across)
            across += rises
            across ^= rises
            across |= equal
            np.bitwise_or(across, rises, out=more)
            np.invert(more, out=more)
            more |= falls
            across &= rises  # where a step to the right is one less
            if w == lowest:
                last = end if w == words - 1 else top
                step = ((more >> last) & one).view(np.int64) - ((across >> last) & one).view(np.int64)
                far += step * (j < n)
            next_plus, next_minus = more >> top, across >> top
            more <<= one
            more |= plus
            across <<= one
            across |= minus
            np.bitwise_and(more, below, out=falls)
            np.bitwise_or(more, below, out=rises)
            np.invert(rises, out=rises)
            rises |= across
            plus, minus = next_plus, next_minus
        if j % 16 == 15 or j + 1 == len(texts):
            left = n - j - 1
            ended = left <= 0
            found[pairs[ended]] = far[ended] <= most[ended]
            stay = np.flatnonzero(~ended & (far - left <= most))
            if not len(stay):
                break
            if len(stay) < len(pairs):
                up, down = [v[stay] for v in up], [v[stay] for v in down]
                far, pairs, most, n, end = far[stay], pairs[stay], most[stay], n[stay], end[stay]
                one, none, top, across, more = (v[: len(stay)] for v in (one, none, top, across, more))
                texts = texts[:, stay]
    return found


def _similar(share: float):
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose edit distance is at most 1 - ``share`` of the longer line."""
        for batch in batches:
            xs, ys = column_of(batch, "x").to_pylist(), column_of(batch, "y").to_pylist()
            found = all_within(xs, ys, [int(max(len(x), len(y)) * round(1 - share, 9)) for x, y in zip(xs, ys)])
            yield batch.select(["a", "b", "run"]).filter(pa.array(found, pa.bool_()))
            del xs, ys, found
            pa.default_memory_pool().release_unused()

    return similar


def _cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, norm) of the wanted lines of each text."""
    for batch in batches:
        nodes, norms = [], []
        for value, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
            lines = list(normal_lines(value.as_py()))
            for want in wanted:
                # A row that repeats an id may hold other lines.
                if want["line"] < len(lines) and _keys(lines[want["line"]]) == (want["k1"], want["k2"]):
                    nodes.append(want["node"])
                    norms.append(lines[want["line"]].decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(norms, pa.string())], ["node", "norm"])


def _with_texts(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, fp, norm) of the lines that stand in pairs, cut from their first documents.

    Few lines are in pairs; they go to the documents if they are few enough to be
    sent there, and meet them by id if not.
    """
    asked = staged(nodes.drop("blocks", "letters").join(_ends(pairs), "node", "left_semi"), "asked-lines")
    want = F.struct("node", "line", "k1", "k2")
    by_doc = staged(asked.groupBy(F.col("doc").alias("of")).agg(F.collect_list(want).alias("wanted")), "asked-documents")
    met = rows.join(broadcast_if_small(by_doc), F.col("doc").eqNullSafe(F.col("of")))
    texts = met.select("text", "wanted").mapInArrow(_cut_lines, "node long, norm string")
    texts = staged(texts, "line-texts").dropDuplicates(["node"])
    return staged(asked.select("node", "fp").join(texts, "node"), "asked-texts")


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b, run) whose lines are similar in text, in runs near in fingerprint too."""
    lines = _with_texts(pairs, nodes, rows)
    one = lines.select(F.col("node").alias("a"), F.col("norm").alias("x"), F.col("fp").alias("f"))
    two = lines.select(F.col("node").alias("b"), F.col("norm").alias("y"), F.col("fp").alias("g"))
    near = F.col("run").isNull() | (F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= RADIUS)
    met = pairs.join(one, "a").join(two, "b").where(near)
    return met.select("a", "b", "run", "x", "y").mapInArrow(_similar(share), "a long, b long, run long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _sharing(met: DataFrame, crowded: DataFrame) -> DataFrame:
    """Pairs (a, b, run, own) that share enough blocks, those of short lines, and those of runs.

    ``met`` has a row for each block that a pair shares, but for crowded ones. Where these alone are
    too few, what the lines share of the blocks of ``crowded`` is added.
    """
    pairs = met.groupBy("a", "b", "run").agg(F.count("most").alias("own"), F.max("most").alias("most"))
    pairs = staged(pairs, "line-candidates")
    enough = F.col("run").isNotNull() | F.coalesce(F.col("own") >= F.col("most") * F.lit(SHARED), F.lit(False))
    lines = _hot_lines(crowded).select("node", "size", "blocks", F.col("hot.key").alias("hot"))
    others = pairs.where(~enough).join(lines.toDF("a", "n", "x", "p"), "a").join(lines.toDF("b", "m", "y", "q"), "b")
    shared = F.col("own") + F.size(F.array_intersect("p", "q")) >= F.greatest("x", "y") * F.lit(SHARED)
    columns = ["a", "b", "run", "own"]
    return pairs.where(enough).select(columns).unionByName(others.where((F.greatest("n", "m") < SHORT) | shared).select(columns))


def _table(kind: int, **columns) -> pa.RecordBatch:
    """Rows of ``_DEALT``; columns that aren't given are null."""
    types = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    names, kinds = zip(*(column.split() for column in _DEALT.split(", ")))
    n = len(next(iter(columns.values())))
    columns["kind"] = np.full(n, kind, np.int32)
    made = [columns.get(name) for name in names]
    made = [pa.nulls(n, types[t]) if c is None else c if isinstance(c, pa.Array) else pa.array(c, types[t]) for c, t in zip(made, kinds)]
    return pa.RecordBatch.from_arrays(made, list(names))


def _cut(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary value of the values between every two cuts."""
    offsets = pa.array((cuts * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(values))])


def _dealt(buckets: int, full_run: int):
    """Distinct lines of a partition sorted by line, their marks, and their blocks in a row for each bucket of keys."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        for part in _parts(_first_of_runs(batches)):
            columns = {c: pa.concat_arrays([column_of(b, c) for b in part]) for c in ("k1", "k2", "doc", "line", "fp", "size")}
            found, letters, first = [], [], 0
            for batch in part:
                lines = column_of(batch, "norm").to_pylist()
                letters += [_letters(line) if len(line) < 4 * SHORT else None for line in lines]
                for some in _by_bytes(lines):
                    owners, keys = _blocks(some, *_word_hashes(some))
                    found.append((owners + first, keys))
                    first += len(some)
            owners, keys = (np.concatenate(c) for c in zip(*found))
            nodes = np.arange(base, base + first)
            of = np.bincount(owners, minlength=first).astype(np.int32)
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(KEY_BITS - 32)).astype(np.uint16)
            yield _table(NODE, **columns, node=nodes, of=of, letters=pa.array(letters, pa.binary()), bucket=(nodes % buckets).astype(np.int32))
            marks = [_cut(columns[c].to_numpy(), np.array([0, first])) for c in ("fp", "size")]
            yield _table(MARKS, base=[base], bucket=[int(nodes[0] % buckets)], fps=marks[0], sizes=marks[1], blocks=_cut(of, np.array([0, first])))
            keys = keys.astype(np.uint32)
            few, hot = _without_hot(bucket, keys, full_run)
            # Of a block of many of these lines, its bucket gets the number only.
            at = np.flatnonzero(~few)
            spread = (nodes[owners[at]] % buckets).astype(np.int32)
            names = bucket[at].astype(np.int64) << 32 | keys[at]
            yield _table(HOT_LINE, key=names, node=nodes[owners[at]], bucket=spread)
            names, held = hot
            yield _table(HOT, key=names, held=held, bucket=(names >> 32).astype(np.int32))
            bucket, keys, owners = bucket[few], keys[few], owners[few].astype(np.uint16)
            order = np.argsort(bucket, kind="stable")
            cuts = np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))
            owners = owners[order]
            cells = {"keys": keys[order], "low": owners.astype(np.uint8), "high": (owners >> 8).astype(np.uint8)}
            there = np.flatnonzero(np.diff(cuts))
            cuts = np.append(cuts[there], len(keys))
            yield _table(CELL, bucket=there, base=np.full(len(there), base), **{c: _cut(v, cuts) for c, v in cells.items()})
            base += first
            del found, owners, keys, few, bucket, order, cells, columns
            pa.default_memory_pool().release_unused()

    return dealt


def _letters(line: bytes) -> bytes | None:
    """How often each of ``KINDS`` kinds of letters occurs in a short line."""
    text = line.decode("utf-8", "replace")
    if len(text) >= SHORT:
        return None
    return np.bincount(np.frombuffer(text.encode("utf-32-le"), "<u4") % KINDS, minlength=KINDS).astype(np.uint8).tobytes()


def _without_hot(bucket: np.ndarray, keys: np.ndarray, full_run: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Which blocks are held by at most ``full_run`` lines; the names of the others and by how many."""
    few = np.ones(len(keys), bool)
    slots = keys >> 12
    at = np.flatnonzero((np.bincount(slots, minlength=1 << 20) > full_run)[slots])
    names, which, held = np.unique(bucket[at].astype(np.int64) << 32 | keys[at], return_inverse=True, return_counts=True)
    many = held > full_run
    few[at[many[which]]] = False
    return few, (names[many], held[many])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Lines of about ``PART_BYTES``, and at most ``PART_LINES``, at a time."""
    held: list[pa.RecordBatch] = []
    size = lines = 0
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(column_of(batch, "norm")).to_numpy())
        first = 0
        while first < batch.num_rows:
            before = int(sizes[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, before + PART_BYTES - size)))
            last = min(last, first + PART_LINES - lines, batch.num_rows)
            held.append(batch.slice(first, last - first))
            size += int(sizes[last - 1]) - before
            lines += last - first
            if size >= PART_BYTES or lines >= PART_LINES or last < batch.num_rows:
                yield held
                held, size, lines = [], 0, 0
            first = last
    if held:
        yield held


def _by_bytes(lines: list[bytes]) -> Iterator[list[bytes]]:
    """Lines of about ``SLICE_BYTES`` at a time."""
    first = size = 0
    for at, line in enumerate(lines, 1):
        size += len(line)
        if size >= SLICE_BYTES or at == len(lines):
            yield lines[first:at]
            first, size = at, 0


def _met(full_run: int):
    """The cells of a bucket without the blocks that a single line has; those of crowded blocks are rows of their own."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def blocks() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = pc.is_in(column_of(batch, "kind"), pa.array([CELL, HOT], pa.int32()))
                passed.append(batch.filter(pc.invert(own)))
                yield batch.filter(own)

        for bucket, rows in _buckets(blocks(), ["kind", "base", "keys", "low", "high", "key", "held"]):
            yield from passed
            passed.clear()
            hot: dict[int, int] = {}
            for kind, *_, name, held in rows:
                if kind == HOT:
                    hot[name] = hot.get(name, 0) + held
            yield from _met_cells(bucket, [row[1:5] for row in rows if row[0] == CELL], hot, full_run)
            pa.default_memory_pool().release_unused()
        yield from passed

    return met


def _met_cells(bucket: int, cells: list[tuple], hot: dict[int, int], full_run: int) -> Iterator[pa.RecordBatch]:
    """What is left of the cells of a bucket; ``hot`` are blocks with lines beside those of the cells."""
    names = np.array(sorted(hot), np.int64)
    counts = np.array([hot[name] for name in names.tolist()], np.int64)
    if not cells:
        yield _table(HOT, key=names, held=counts)
        return
    bases, keys, low, high = zip(*cells)
    keys = np.frombuffer(b"".join(keys), np.uint32)
    slots = keys >> 11
    held = np.bincount(slots, minlength=1 << 21)
    held[(names & 0xFFFFFFFF) >> 11] += 1
    at = np.flatnonzero(held[slots] > 1)
    order = np.sort(keys[at].astype(np.uint64) << np.uint64(32) | np.arange(len(at), dtype=np.uint64))
    at = at[(order & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    keys, nodes = keys[at], _nodes(bases, low, high)[at]
    # Two blocks of a line that are one here count once.
    fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])))[: len(keys)]
    at, keys, nodes = at[fresh], keys[fresh], nodes[fresh]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
    own = np.diff(np.append(starts, len(keys)))
    blocks = np.int64(bucket) << 32 | keys[starts].astype(np.int64)
    total = own + _at(blocks, names, counts)
    crowded = total > full_run
    lines = np.repeat(crowded, own)
    yield _table(HOT_LINE, key=np.repeat(blocks, own)[lines], node=nodes[lines])
    apart = ~np.isin(names, blocks)
    yield _table(HOT, key=np.append(blocks[crowded], names[apart]), held=np.append(total[crowded], counts[apart]))
    few = np.flatnonzero(np.repeat((total > 1) & ~crowded, own))
    part = np.repeat(np.arange(len(cells)), [len(c) for c in low])[at[few]]
    order = np.lexsort((nodes[few], part))
    few, part = few[order], part[order]
    there, cuts = np.unique(part, return_index=True)
    places = nodes[few] - np.array(bases, np.int64)[part]
    columns = {"keys": keys[few], "low": places.astype(np.uint8), "high": (places >> 8).astype(np.uint8)}
    cuts = np.append(cuts, len(few))
    bases = np.array(bases, np.int64)[there]
    yield _table(CELL, bucket=np.full(len(there), bucket), base=bases, **{c: _cut(v, cuts) for c, v in columns.items()})


def _at(wanted: np.ndarray, names: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each wanted one of sorted names, 0 if it isn't there."""
    place = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return np.where(names[place] == wanted, values[place], 0) if len(names) else np.zeros(len(wanted), np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells with fingerprints, sizes and numbers of blocks; the marks of a base come before its cells."""
    marks: dict[str, np.ndarray] = {}
    for batch in batches:
        made = []
        for row in batch.to_pylist():
            if row["kind"] == MARKS:
                marks = {c: np.frombuffer(row[c], t) for c, t in (("fps", np.int64), ("sizes", np.int32), ("blocks", np.int32))}
            else:
                at = _nodes((0,), (row["low"],), (row["high"],))
                own = [marks["fps"][at].tobytes(), _halved(marks["sizes"][at]), _halved(marks["blocks"][at])]
                made.append([row["bucket"], row["base"], row["keys"], row["low"], row["high"], *own])
        types = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        names = [column.split()[0] for column in _CELL.split(", ")]
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)


def line_blocks(rows: DataFrame, full_run: int = FULL_RUN) -> DataFrame:
    """``_DEALT`` rows of (doc, text): the distinct lines, their marks, and the blocks that several of them have.

    Most blocks are a single line's, so keys are met first, packed by ranges of keys; a line's blocks go with its
    text to where its copies are found, and no further.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = -(-size // (BLOCK_BYTES * BUCKET))
    buckets = min(1 << 16, max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets))
    partial = rows.mapInArrow(_scan(True), _LINE).repartition("k1", "k2")
    ordered = partial.sortWithinPartitions("k1", "k2", F.asc_nulls_last("doc"), "line")
    dealt = ordered.mapInArrow(_dealt(buckets, full_run), _DEALT)
    dealt = dealt.repartition(max(1, buckets // 2), "bucket").sortWithinPartitions("bucket")
    return staged(dealt.mapInArrow(_met(full_run), _DEALT), "line-blocks", "kind")


def shared_blocks(nodes: DataFrame, full_run: int = FULL_RUN) -> DataFrame:
    """(key, node, held) of each block that 2 to ``full_run`` lines share; of others above, a row without a node.

    For lines that have their ``blocks`` beside them; :func:`line_blocks` has no need of these.
    """
    keyed = nodes.select("node", F.explode("blocks").alias("key"))
    held = keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    few = keyed.join(held.where(F.col("held") <= full_run), "key").select("key", "node", "held")
    return few.unionByName(held.where(F.col("held") > full_run).select("key", F.lit(None).cast("long").alias("node"), "held"))


def crowded_blocks(nodes: DataFrame, full_run: int = FULL_RUN, shared: DataFrame | None = None) -> DataFrame:
    """(key, held) of the blocks that more than ``full_run`` lines share."""
    shared = shared_blocks(nodes, full_run) if shared is None else shared
    return shared.where("node is null").select("key", "held")


def crowded_lines(nodes: DataFrame, hot: DataFrame) -> DataFrame:
    """(key, held, node, fp, size, blocks) of the lines of each crowded block; ``blocks`` counts all of a line."""
    keyed = nodes.select("node", "fp", "size", F.size("blocks").alias("blocks"), F.explode("blocks").alias("key"))
    return staged(keyed.join(broadcast_if_small(hot), "key"), "crowded-lines")


def _hot_lines(crowded: DataFrame) -> DataFrame:
    """(node, fp, size, blocks, hot) of the lines in crowded blocks; ``hot`` are these blocks, the smallest first."""
    hot = F.array_sort(F.collect_list(F.struct("held", "key"))).alias("hot")
    return crowded.groupBy("node").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("blocks").alias("blocks"), hot)


def candidate_pairs(
    nodes: DataFrame, shared: DataFrame, crowded: DataFrame, share: float = SIMILAR, full_run: int = FULL_RUN
) -> DataFrame:
    """(a, b, run, most) of the distinct lines that meet on a block, a row for each block.

    On ``crowded`` blocks only lines near in fingerprint meet here, see :func:`crowded_pairs`.
    """
    lines = nodes.select("node", "fp", "size", F.size("blocks").alias("blocks"))
    few = shared.where("node is not null").select("key", "node").join(lines, "node")
    few = few.repartition("key").sortWithinPartitions("key", "node")
    return few.mapInArrow(_block_pairs(share), _PAIRS).unionByName(_near_on_crowded(crowded, full_run))


def _cell_candidates(dealt: DataFrame, crowded: DataFrame, share: float, full_run: int) -> DataFrame:
    """:func:`candidate_pairs` of packed blocks: the marks of lines go to their cells, and these to their buckets."""
    cells = dealt.where(F.col("kind").isin(CELL, MARKS)).select("kind", *(c.split()[0] for c in _CELL.split(", ")))
    cells = cells.repartition("base").sortWithinPartitions("base", F.desc("kind")).mapInArrow(_marked, _CELL)
    cells = cells.repartition("bucket").sortWithinPartitions("bucket")
    return cells.mapInArrow(_cell_pairs(share), _PAIRS).unionByName(_near_on_crowded(crowded, full_run))


def _near_on_crowded(crowded: DataFrame, full_run: int) -> DataFrame:
    crowded = crowded.select("key", "node", "fp").mapInArrow(_refined, "key long, node long, fp long")
    crowded = crowded.repartition("key").sortWithinPartitions("key", "node")
    return crowded.mapInArrow(_pairs(full_run), _PAIRS)


def _bit_sets(keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each line as bits, as many as the key weighs, of those keys that at least two of the lines have.

    Bits are in the order of keys; the second result has the keys and their first bits.
    """
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    names, first, at, held = np.unique(np.concatenate(keys), return_index=True, return_inverse=True, return_counts=True)
    weight = np.where(held > 1, np.concatenate(weights)[first], 0)
    place = np.cumsum(weight) - weight
    count = weight[at]
    bits = np.repeat(place[at], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    sets = np.zeros((len(keys), max(1, -(-int(weight.sum()) // 64))), np.uint64)
    np.bitwise_or.at(sets, (np.repeat(owner, count), bits >> 6), np.uint64(1) << (bits & 63).astype(np.uint64))
    return sets, np.array([names, place])


def _dealt_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of slices that a line of crowded blocks meets others in.

    Two lines that must share n blocks share one of all but the n - 1 most crowded ones of each.
    """
    for batch in batches:
        hot = column_of(batch, "hot")
        key, held, weight = (hot.flatten().field(c).to_numpy() for c in ("key", "held", "weight"))
        counts = hot.value_lengths().to_numpy()
        owner = np.repeat(np.arange(len(hot)), counts)
        after = np.cumsum(weight[::-1])[::-1]  # with the blocks of later lines
        ends = np.cumsum(counts)
        after -= np.append(after, 0)[ends][owner]
        size, blocks = (column_of(batch, c).to_numpy() for c in ("size", "blocks"))
        must = np.where(size < SHORT, 1, np.ceil(blocks * SHARED))
        near = after > must[owner] - 1
        number = np.bincount(owner, near, len(hot)).astype(np.int32)
        owner, key, parts = owner[near], key[near], -(-held[near] // SLICE_LINES)
        part = (_mixed(column_of(batch, "node").to_numpy()[owner], key).view(np.uint64) >> np.uint64(8)) % parts.astype(np.uint64)
        part = part.astype(np.int64)
        other = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        owner, key, part = (np.repeat(c, parts) for c in (owner, key, part))
        run = _mixed(key, np.minimum(part, other) << 32 | np.maximum(part, other))
        cuts = pa.array(np.append(0, ends).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, hot.flatten().field(c)) for c in ("key", "weight")]
        for first in range(0, len(owner), 10_000):
            some = slice(first, first + 10_000)
            at = pa.array(owner[some])
            columns = [pa.array(run[some]), pa.array(key[some]), pa.array(part[some].astype(np.int32)), pa.array(other[some].astype(np.int32))]
            columns.append(pa.array(number[owner[some]]))
            columns += [column_of(batch, c).take(at) for c in ("node", "fp", "size", "root", "blocks", "letters")]
            yield pa.RecordBatch.from_arrays([*columns, *(c.take(at) for c in lists)], [c.split()[0] for c in _RUN.split(", ")])


def _mixed(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    mixed = one.astype(np.int64).view(np.uint64)
    for other in (np.uint64(0), two.astype(np.int64).view(np.uint64), np.uint64(0)):
        mixed = (mixed ^ other) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    return mixed.view(np.int64)


def _slice_pairs(share: float):
    """Pairs of different groups, near in length and fingerprint, of one slice of a block or of two.

    They share enough crowded blocks; pairs that share others too have met on these. A pair comes from the first
    of the blocks on which it meets.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = ["key", "part", "other", "near", "node", "fp", "size", "root", "blocks", "letters", "hot", "weight"]
        for _, (key, part, other, number, node, fp, size, root, blocks, letters, hot, weight) in keyed_runs(batches, "run", order):
            fp = fp.view(np.uint64)
            held, _ = _bit_sets(hot, weight)
            met, (names, place) = _bit_sets([h[:n] for h, n in zip(hot, number)], [np.ones(n, np.int64) for n in number])
            bit = int(place[np.searchsorted(names, key[0])])
            earlier = met[:, : (bit >> 6) + 1].copy()
            earlier[:, -1] &= np.uint64((1 << (bit & 63)) - 1)
            step = max(1, min(10_000, (1 << 21) // held.shape[1]))
            counts = np.frombuffer(b"".join(c or bytes(KINDS) for c in letters), np.uint8).reshape(-1, KINDS).astype(np.int8)
            counted = np.array([c is not None for c in letters])
            left = np.flatnonzero(part == part[0])
            right = np.flatnonzero(part != part[0])
            own = part[0] == other[0]
            right = left if own else right
            for low in range(0, len(left), 256):
                some = left[low : low + 256]
                near = root[some][:, None] != root[right][None, :]
                if own:
                    near &= node[some][:, None] < node[right][None, :]
                if not near.any():
                    continue
                near &= _may(fp[some], size[some], fp[right], size[right], share)
                i, j = np.nonzero(near)
                for at in range(0, len(i), step):
                    x, y = some[i[at : at + step]], right[j[at : at + step]]
                    first = ~(earlier[x] & earlier[y]).any(axis=1)
                    x, y = x[first], y[first]
                    shared = np.bitwise_count(held[x] & held[y]).sum(axis=1, dtype=np.int64)
                    longest = np.maximum(size[x], size[y])
                    enough = (longest < SHORT) | (shared >= np.maximum(blocks[x], blocks[y]) * SHARED)
                    # An edit takes a letter away, or adds one, or both, so as many edits as these are needed.
                    more = counts[x] - counts[y]
                    apart = np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))
                    enough &= (apart <= np.floor(longest * round(1 - share, 9))) | ~(counted[x] & counted[y])
                    a, b = node[x[enough]], node[y[enough]]
                    ends = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]
                    yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    return pairs


def crowded_pairs(
    nodes: DataFrame, hot: DataFrame, roots: DataFrame, share: float = SIMILAR, crowded: DataFrame | None = None
) -> DataFrame:
    """(a, b) of the lines that share crowded blocks only, are in no group together and near in length and fingerprint.

    Blocks of the same lines are one, that weighs as many. The lines of a block are dealt into slices, and
    every two slices meet in a run of their own, so a block of any size spreads over many tasks.
    """
    crowded = crowded_lines(nodes, hot) if crowded is None else crowded
    same = crowded.groupBy("key").agg(F.first("held").alias("held"), F.bit_xor(F.xxhash64("node")).alias("lines"))
    same = same.groupBy("held", "lines").agg(F.min("key").alias("key"), F.count("*").cast("int").alias("weight"))
    same = staged(same.select("key", "weight"), "crowded-blocks")
    must = F.when(F.col("size") < SHORT, F.lit(1)).otherwise(F.ceil(F.col("blocks") * F.lit(SHARED)))
    hot = F.array_sort(F.collect_list(F.struct("held", "key", "weight"))).alias("hot")
    if "letters" not in crowded.columns:
        crowded = crowded.withColumn("letters", F.lit(None).cast("binary"))
    marks = [F.first(c).alias(c) for c in ("fp", "size", "blocks", "letters")]
    lines = crowded.join(broadcast_if_small(same), "key").groupBy("node").agg(*marks, hot, F.sum("weight").alias("all"))
    named = lines.where(F.col("all") >= must).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    dealt = named.select("node", "fp", "size", "root", "blocks", "letters", "hot").mapInArrow(_dealt_lines, _RUN)
    dealt = dealt.repartition("run").sortWithinPartitions("run", "part", "node")
    return dealt.mapInArrow(_slice_pairs(share), "a long, b long")


def line_links(dealt: DataFrame, rows: DataFrame, share: float = SIMILAR, full_run: int = FULL_RUN) -> DataFrame:
    """Links (a, b) that connect the distinct lines of :func:`line_blocks` as all similar pairs that meet do."""
    nodes = dealt.where(F.col("kind") == NODE).select("node", "k1", "k2", "doc", "line", "fp", "size", F.col("of").alias("blocks"), "letters")
    hot = dealt.where(F.col("kind") == HOT).select("key", "held")
    crowded = dealt.where(F.col("kind") == HOT_LINE).select("key", "node").join(broadcast_if_small(hot), "key")
    crowded = staged(crowded.join(nodes.select("node", "fp", "size", "blocks", "letters"), "node"), "crowded-lines")
    # Of the pairs of a line, that with most in common is checked first; others if it leaves them apart.
    by_own = Window.partitionBy("b", F.col("run").isNull()).orderBy(F.desc("own"), "a")
    spare = F.col("run").isNull() & (F.row_number().over(by_own) > 1)
    met = _sharing(_cell_candidates(dealt, crowded, share, full_run), crowded)
    met = staged(met.select("a", "b", "run", spare.alias("spare")), "line-pairs")
    found = staged(_verified(met.where("not spare"), nodes, rows, share), "line-links")
    runs = met.where("run is not null")
    # Lines of long runs that aren't linked to the first one meet all the others.
    linked = found.where("run is not null").select("b", "run")
    left = staged(runs.join(linked, ["b", "run"], "left_anti").select(F.col("b").alias("a"), "run").distinct(), "line-rest")
    again = left.join(runs.select("b", "run"), "run").where("a <> b")
    again = again.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # What is one group by now needs no further check.
    roots = staged(connected_components(found.select("a", "b")), "line-groups")
    near = nodes.select("node", "fp")
    again = again.distinct().join(near.toDF("a", "f"), "a").join(near.toDF("b", "g"), "b")
    again = again.where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= RADIUS).select("a", "b")
    rest = crowded_pairs(nodes, hot, roots, share, crowded)
    more = met.where("spare").select("a", "b").unionByName(again).unionByName(rest).distinct()
    for end in ("a", "b"):
        more = more.join(roots.toDF(end, f"root_{end}"), end, "left")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    more = more.where(apart).select("a", "b", F.lit(None).cast("long").alias("run"))
    more = staged(more, "line-rest-pairs")
    return found.select("a", "b").unionByName(_verified(more, nodes, rows, share).select("a", "b"))


# --- groups --------------------------------------------------------------------


def mark_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SIMILAR, full_run: int = FULL_RUN
) -> DataFrame:
    """(doc, line, keep) for every line with words; ``line`` counts all lines from 0.

    Of each group the occurrence in the smallest document, then line, stays. Lines
    without words belong to no group. Null and empty texts have no lines to mark.
    Rows that repeat an id are decided alike. Rows without an id come last, and as one
    document. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    dealt = line_blocks(rows, full_run)
    nodes = dealt.where(F.col("kind") == NODE).select("node", "k1", "k2", "doc", "line")
    roots = staged(connected_components(line_links(dealt, rows, share, full_run)), "line-roots")
    grouped = nodes.select("node", "doc", "line").join(roots, "node")
    place = F.struct(F.col("doc").isNull().alias("void"), "doc", "line")
    firsts = grouped.groupBy("root").agg(F.min(place).alias("place"))
    # Distinct lines that are not their group's first: all their occurrences go.
    lost = staged(
        grouped.join(firsts, "root").where(~place.eqNullSafe(F.col("place"))).select("node"), "lost-lines"
    )
    kept = nodes.join(lost, "node", "left_anti").select("k1", "k2", F.col("doc").alias("at_doc"), F.col("line").alias("at_line"))
    lines = rows.mapInArrow(_scan(False), "k1 long, k2 long, doc long, line long")
    marked = lines.join(kept, ["k1", "k2"], "left")
    stays = F.col("doc").eqNullSafe(F.col("at_doc")) & (F.col("line") == F.col("at_line"))
    return marked.select("doc", "line", F.coalesce(stays, F.lit(False)).alias("keep"))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept and dropped_sha256 of every document.

    ``n_lines`` counts lines with words; the hash is over the numbers of dropped lines,
    in order, comma-joined.
    """
    marked = mark_lines(docs).groupBy("doc").agg(
        F.count("*").alias("n_lines"),
        F.count_if("keep").alias("n_kept"),
        F.array_sort(F.collect_list(F.when(~F.col("keep"), F.col("line")))).alias("dropped"),
    )
    ids = docs.select("doc_id")
    joined = ids.join(marked, ids["doc_id"].eqNullSafe(marked["doc"]), "left")
    return joined.select(
        "doc_id",
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("n_kept", F.lit(0)).alias("n_kept"),
        F.sha2(F.coalesce(F.array_join("dropped", ","), F.lit("")), 256).alias("dropped_sha256"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines cut from their texts; all columns stay."""
    name, key = free_name(docs, "_dropped"), free_name(docs, "_doc")
    lost = mark_lines(docs, id_col, text_col).where(~F.col("keep")).groupBy("doc").agg(F.collect_set("line").alias(name))
    lost = lost.withColumnRenamed("doc", key)
    joined = docs.join(lost, docs[id_col].cast("long").eqNullSafe(lost[key]), "left")
    dropped = F.map_from_arrays(name, F.transform(name, lambda _: F.lit(True)))
    lines = F.filter(F.split(docs[text_col], "\n"), lambda _, i: F.element_at(dropped, i.cast("long")).isNull())
    text = F.when(F.col(name).isNull(), docs[text_col]).otherwise(F.array_join(lines, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
