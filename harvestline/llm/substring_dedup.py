"""Repeated passages of documents, found by backward search in FM-indexes.

A window of ``WIDTH`` words is a repeat if the same words also start earlier, in the
order of (id, place). The corpus is cut into shards by content, so that equal windows
meet in one shard, and each word is indexed where its anchor says and nowhere else:

1. Every window has an anchor, its gram of ``GRAM`` words with the smallest hash. A run
   of windows with one anchor is a piece, and pieces meet by anchor. Only hashes and
   places travel here. Equal pieces are combined within a batch before the shuffle. All
   but the earliest of equal pieces are repeats, as is each of their windows.
2. Pieces whose anchor no other content has are done. The earliest of each of the others
   fetch their words and form shards of bounded size. A shard is a compressed FM-index:
   the wavelet matrix of its Burrows-Wheeler transform and a sampled suffix array. The
   pieces stream past it and get the matching statistics of each window: how many of its
   last words occur once more. Where these reach ``WIDTH``, the interval of the suffix
   array names all places of the window, and the earliest of them tells the repeats.

An anchor of over ``HOT_ROWS`` combined pieces, such as a phrase that a third of all
documents hold amid other words, would make a shard too large. Its windows are dealt one
by one, by the hash of all their words, and equal windows are combined like equal pieces.

Equal pieces are told by 128 bits: the hash of the anchor and that of all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, column_of, free_name, staged

by_value(__name__)

WIDTH = 20
GRAM = 6
# Rows of an anchor beyond which its windows are dealt one by one, and the most anchors
# that travel to the tasks for it: those with most rows.
HOT_ROWS = 2_000
MAX_HOT = 200_000
# Words of a shard, about: it ends with the anchor that reaches this.
SHARD_WORDS = 300_000
# Words that are hashed at once; longer texts are cut, with windows across the cuts.
SLICE_WORDS = 100_000
# Every so many words of a shard keep their place in the suffix array.
SAMPLE = 8
_PLACE_BITS = 20
_RUN_BITS = 12  # of a packed run of windows: place above, number below
_FACTOR = 0x9E3779B97F4A7C15  # odd, so it has an inverse among 64-bit numbers
_U = np.uint64


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of anything but the six ASCII white space characters."""
    return (text or b"").split()


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


# --- pieces -----------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Sums:
    """Hashes of any runs of words, from running sums of the words' hashes."""

    def __init__(self, marks: np.ndarray):
        n = len(marks)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(marks * _powers(_FACTOR, n), dtype=np.uint64)))
        self.back = _powers(pow(_FACTOR, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        runs = (self.sums[end] - self.sums[start]) * self.back[start]
        return _mix(runs + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def _slices(texts: Iterator[bytes | None], width: int) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words of several texts, with (text's number, place in it, words) of each part."""
    words: list[bytes] = []
    parts: list[tuple[int, int, int]] = []
    for number, text in enumerate(texts):
        own = words_of(text)
        for at in range(0, len(own) - width + 1, SLICE_WORDS):
            part = own[at : at + SLICE_WORDS + width - 1]
            words += part
            parts.append((number, at, len(part)))
            if len(words) >= SLICE_WORDS:
                yield words, parts
                words, parts = [], []
    if parts:
        yield words, parts


def _anchors(grams: np.ndarray, reach: int) -> np.ndarray:
    """Place of the smallest of every ``reach`` neighbouring hashes, the first of equals."""
    places = np.arange(len(grams), dtype=np.uint64)
    low = (grams >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | places
    done = 1
    while done < reach:
        step = min(done, reach - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    return (low & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)


def _pieces(words: list[bytes], parts: list[tuple[int, int, int]], width: int, gram: int, hot: np.ndarray):
    """(key, content, text's number, place of the first window, windows) of a slice's pieces, as arrays."""
    from xxhash import xxh64_intdigest

    marks = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    contents, grams_of = _Sums(_mix(marks + _U(_FACTOR))), _Sums(marks)
    at = np.arange(len(words) - gram + 1)
    grams = grams_of.of(at, at + gram)
    number, place, size = (np.array(x, np.int64) for x in zip(*parts))
    begin = np.cumsum(size) - size
    windows = size - width + 1  # those that stay within their part
    of = np.repeat(np.arange(len(size)), windows)
    first = begin[of] + _within(windows)
    anchor = _anchors(grams, width - gram + 1)[first]
    cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1]))))
    n = np.diff(np.concatenate((cut, [len(first)])))
    start, key, of = first[cut], grams[anchor[cut]], of[cut]
    spot = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
    if spot.any():
        single = np.repeat(start[spot], n[spot]) + _within(n[spot])
        start = np.concatenate((start[~spot], single))
        key = np.concatenate((key[~spot], _mix(grams_of.of(single, single + width) + _U(1))))
        of = np.concatenate((of[~spot], np.repeat(of[spot], n[spot])))
        n = np.concatenate((n[~spot], np.ones(len(single), np.int64)))
    content = contents.of(start, start + n + width - 1)
    return key, content, number[of], start - begin[of] + place[of], n


def _scan(width: int, gram: int, hot: np.ndarray):
    """Pieces of the texts of each batch; all but the earliest of equal ones are marked as done."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = column_of(batch, "row").to_numpy()
            once = np.unique(rows, return_index=True)[1]  # rows that repeat one another are one
            batch, rows = batch.take(pa.array(once)), rows[once]
            ids = column_of(batch, "id")
            known, missing = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            texts = (text.as_py() for text in column_of(batch, "text").cast(pa.binary()))
            found = [_pieces(words, parts, width, gram, hot) for words, parts in _slices(texts, width)]
            if not found:
                continue
            key, content, number, start, n = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((start, rows[number], known[number], missing[number], content, key))
            key, content, number, start, n = (x[order] for x in (key, content, number, start, n))
            done = np.concatenate(([False], (key[1:] == key[:-1]) & (content[1:] == content[:-1])))
            # Pieces that are done meet no others; a key of their own spreads them.
            own = _mix(rows[number].astype(np.int64).view(np.uint64) + _mix(start.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.where(done, own, key).view(np.int64)), pa.array(content.view(np.int64)),
                    pa.array(known[number], mask=missing[number]), pa.array(rows[number]), pa.array(start), pa.array(n),
                    pa.array(done),
                ],
                ["key", "content", "id", "row", "start", "n", "done"],
            )

    return scanned


def _occurrences(docs: DataFrame, width: int, gram: int, hot: np.ndarray) -> DataFrame:
    """Pieces of (id, row, text)."""
    schema = "key long, content long, id long, row long, start long, n long, done boolean"
    return docs.mapInArrow(_scan(width, gram, hot), schema)


def _hot_anchors(docs: DataFrame, width: int, gram: int, hot_rows: int) -> np.ndarray:
    """Anchors of too many pieces for one shard."""
    pieces = _occurrences(docs, width, gram, np.empty(0, np.uint64)).where("not done")
    counted = pieces.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > hot_rows)
    keys = [r["key"] for r in counted.orderBy(F.desc("rows"), "key").limit(MAX_HOT).collect()]
    return np.array(keys, np.int64).view(np.uint64)


def _met(pieces: DataFrame) -> DataFrame:
    """(key, row, start, n, repeat): pieces that are repeats, and those that are left to a shard."""
    by_key = Window.partitionBy("key")
    equal = Window.partitionBy("key", "content").orderBy(F.col("id").asc_nulls_last(), "row", "start")
    seen = pieces.withColumn("several", F.min("content").over(by_key) < F.max("content").over(by_key))
    seen = seen.withColumn("repeat", F.col("done") | (F.rank().over(equal) > 1))
    return seen.where("repeat or several").select("key", "row", "start", "n", "repeat")


# --- index ------------------------------------------------------------------


class WaveletMatrix:
    """Symbols of a text as bit vectors with counts, for access and rank of many places at once."""

    def __init__(self, symbols: np.ndarray, distinct: int):
        self.levels = max(1, int(distinct - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        left = symbols
        for level in range(self.levels - 1, -1, -1):
            bits = ((left >> level) & 1).astype(bool)
            padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(words)
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.counts.append(np.concatenate(([0], ones[:-1])).astype(np.int32))
            self.zeros.append(int(len(bits) - ones[-1]))
            left = np.concatenate((left[~bits], left[bits]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = self.words[level][block] & ((_U(1) << (at & 63).astype(np.uint64)) - _U(1))
        return self.counts[level][block] + np.bitwise_count(below)

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a symbol's occurrences before ``at`` end in the order of the last level."""
        for level in range(self.levels):
            ones = self._ones(level, at)
            high = (symbol >> (self.levels - 1 - level)) & 1
            at = np.where(high == 1, self.zeros[level] + ones, at - ones)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, its place in the order of the last level) at each place."""
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            ones = self._ones(level, at)
            bit = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64)).astype(np.int64) & 1
            symbol = (symbol << 1) | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return symbol, at


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array, by doubling. A 0 ends a piece, and of two ends the first is smaller."""
    n = len(text)
    stops = np.cumsum(text == 0)
    rank = np.where(text == 0, stops - 1, text + stops[-1])
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        both = rank * (int(rank.max()) + 2) + follow
        order = np.argsort(both)
        ranked = np.concatenate(([0], np.cumsum(np.diff(both[order]) != 0)))
        if ranked[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = ranked
        step *= 2


class FMIndex:
    """Index of pieces of text: one array of symbols from 1, with a 0 after each piece."""

    def __init__(self, text: np.ndarray):
        self.size = len(text)
        order = suffix_order(text)
        symbols = int(text.max()) + 1
        before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))[:-1]
        last = text[order - 1]
        self.wavelet = WaveletMatrix(last, symbols)
        # From the order of the wavelet's last level to the suffix that starts with the symbol.
        self.shift = before - self.wavelet.walk(np.arange(symbols), np.zeros(symbols, np.int64))
        # The first word of a piece has no one word before it, so it always keeps its place.
        self.kept = (order % SAMPLE == 0) | (last == 0)
        self.number = (np.cumsum(self.kept) - 1).astype(np.int32)
        self.places = order[self.kept].astype(np.int32)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that have one symbol more at their front."""
        n, shift = len(symbol), self.shift[symbol]
        both = self.wavelet.walk(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return both[:n] + shift, both[n:] + shift

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, width: int):
        """(length, low, high): how many symbols before each end, ``width`` at most, occur at least twice here.

        ``text`` streams past; it is indexed itself, so every run of it occurs at least once.
        """
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size)
        live = np.arange(len(ends))
        for step in range(1, width + 1):
            low[live], high[live] = self.extend(text[ends[live] - step], low[live], high[live])
            live = live[high[live] - low[live] > 1]
            if not len(live):
                break
            length[live] = step
        return length, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the suffix array."""
        rows, places = rows.copy(), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while True:
            found = self.kept[rows[left]]
            hit = left[found]
            places[hit] += self.places[self.number[rows[hit]]]
            left = left[~found]
            if not len(left):
                return places
            symbol, at = self.wavelet.access(rows[left])
            rows[left] = at + self.shift[symbol]
            places[left] += 1


def shard_repeats(pieces: list[list[bytes]], order: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window) of all windows that also start at a smaller (order, place).

    ``order`` numbers the pieces' documents, ``starts`` has the places of the pieces in them.
    """
    codes: dict[bytes, int] = {}
    sizes = np.array([len(p) for p in pieces])
    begins = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(pieces), np.int64)
    inside = np.ones(len(text), bool)
    inside[begins + sizes] = False
    text[inside] = np.fromiter((codes.setdefault(w, len(codes) + 1) for p in pieces for w in p), np.int64, int(sizes.sum()))
    index = FMIndex(text)
    windows = sizes - width + 1
    of, window = np.repeat(np.arange(len(pieces)), windows), _within(windows)
    length, low, high = index.matching_statistics(text, begins[of] + window + width, width)
    above = np.flatnonzero(length == width)
    if not len(above):
        return above, above
    # Equal windows share their interval; intervals of one length don't overlap otherwise.
    low, one, interval = np.unique(low[above], return_index=True, return_inverse=True)
    counts = high[above[one]] - low
    places = index.locate(np.repeat(low, counts) + _within(counts))
    piece = np.searchsorted(begins, places, side="right") - 1

    def at(piece: np.ndarray, window: np.ndarray) -> np.ndarray:
        return (order[piece] << 32) + starts[piece] + window

    earliest = np.minimum.reduceat(at(piece, places - begins[piece]), np.cumsum(counts) - counts)
    repeated = above[earliest[interval] < at(of[above], window[above])]
    return of[repeated], window[repeated]


# --- shards -----------------------------------------------------------------


def _cut_pieces(width: int):
    """The words of each row's pieces; ``runs`` holds (key, start, n)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = column_of(batch, "row").to_numpy()
            out = []
            for i in np.unique(rows, return_index=True)[1].tolist():
                words = words_of(batch.column(batch.schema.get_field_index("text"))[i].cast(pa.binary()).as_py())
                id_, row = column_of(batch, "id")[i].as_py(), int(rows[i])
                for run in column_of(batch, "runs")[i].as_py():
                    part = words[run["start"] : run["start"] + run["n"] + width - 1]
                    out.append((run["key"], id_, row, run["start"], b" ".join(part)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "id", "row", "start", "words"])

    return cut


def _search(width: int, shard_words: int):
    """Repeats of a partition sorted by key, shard by shard."""

    def repeats(shard: list[tuple]) -> pa.RecordBatch:
        shard = list(dict.fromkeys(shard))  # rows that repeat one another are one
        ids = np.array([s[1] or 0 for s in shard], np.int64)
        missing = np.array([s[1] is None for s in shard])
        row, start = (np.array([s[i] for s in shard], np.int64) for i in (2, 3))
        sort = np.lexsort((row, ids, missing))
        new = (np.diff(missing[sort]) != 0) | (np.diff(ids[sort]) != 0) | (np.diff(row[sort]) != 0)
        order = np.empty(len(shard), np.int64)
        order[sort] = np.concatenate(([0], np.cumsum(new)))
        piece, window = shard_repeats([s[4].split() for s in shard], order, start, width)
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(piece) != 0) | (np.diff(window) != 1)))) if len(piece) else piece
        n = np.diff(np.concatenate((cut, [len(piece)])))
        first = piece[cut]
        arrays = [row[first], start[first] + window[cut], n]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["row", "start", "n"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        size = 0
        for batch in batches:
            for piece in zip(*(column_of(batch, c).to_pylist() for c in ("key", "id", "row", "start", "words"))):
                if size >= shard_words and piece[0] != shard[-1][0]:
                    yield repeats(shard)
                    shard, size = [], 0
                shard.append(piece)
                size += piece[4].count(b" ") + 2
        if shard:
            yield repeats(shard)

    return searched


def repeated_windows(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot_rows: int = HOT_ROWS, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(row, start, n): runs of windows of (id, row, text) that also start earlier. Runs may touch."""
    hot = _hot_anchors(docs, width, gram, hot_rows)
    met = staged(_met(_occurrences(docs, width, gram, hot)), "pieces")
    asked = met.where("not repeat").groupBy("row").agg(F.collect_set(F.struct("key", "start", "n")).alias("runs"))
    pieces = docs.join(asked, "row").mapInArrow(_cut_pieces(width), "key long, id long, row long, start long, words binary")
    shards = pieces.repartition("key").sortWithinPartitions("key")
    searched = staged(shards.mapInArrow(_search(width, shard_words), "row long, start long, n long"), "shard-repeats")
    return met.where("repeat").select("row", "start", "n").unionByName(searched)


# --- documents --------------------------------------------------------------

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("kept", T.StringType()),
    ]
)


def _remover(width: int):
    @F.pandas_udf(FOUND)
    def remove(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_remove(text, packed, width) for text, packed in zip(texts, runs)], columns=FOUND.names)

    return remove


def _remove(text: str | None, packed: np.ndarray | None, width: int) -> tuple:
    words = words_of((text or "").encode())
    if packed is None or not len(packed):
        return len(words), 0, [], [], b" ".join(words).decode()
    packed = np.asarray(packed, np.int64)
    edges = np.zeros(len(words) + 1, np.int64)
    start = packed >> _RUN_BITS
    np.add.at(edges, start, 1)
    np.add.at(edges, start + (packed & ((1 << _RUN_BITS) - 1)) + width - 1, -1)
    gone = np.cumsum(edges) > 0
    turns = np.diff(np.concatenate(([0], gone)).astype(np.int8))
    kept = [w for w, g in zip(words, gone.tolist()) if not g]
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    return len(words), len(words) - len(kept), starts.tolist(), ends.tolist(), b" ".join(kept).decode()


def find_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    gram: int = GRAM,
    hot_rows: int = HOT_ROWS,
    shard_words: int = SHARD_WORDS,
    output: str = "repeats",
) -> DataFrame:
    """``docs`` with a struct ``output``: n_words, n_removed, starts and ends of removed word runs, kept.

    A word is removed if a window of ``width`` words covers it whose words also start
    earlier: in a document of smaller id, or in the same one. ``kept`` joins the other
    words by one blank. Null and empty texts, and those of fewer words than a window,
    lose nothing. Rows without an id come last. Of different texts with one id, or
    without, the one with the smaller hash comes first; rows that repeat both id and
    text are one document, so they don't remove each other's words. ``docs`` must read
    the same when it is read again. A column that has the name ``output`` already
    gives the new one underscores at its end.
    """
    if not 0 < gram <= width < 1 << _RUN_BITS:
        raise ValueError(f"a gram of {gram} and a window of {width} words")
    row, runs, name = free_name(docs, "_row"), free_name(docs, "_runs"), free_name(docs, output)
    text = F.col(text_col).cast("string")
    number = F.xxhash64(F.col(id_col).cast("long"), text)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), number.alias("row"), text.alias("text"))
    found = repeated_windows(plain.where("text is not null"), width, gram, hot_rows, shard_words)
    packed = F.collect_set(F.col("start") * (1 << _RUN_BITS) + F.col("n"))
    by_row = found.groupBy(F.col("row").alias(row)).agg(packed.alias(runs))
    joined = docs.withColumn(row, number).join(by_row, row, "left")
    return joined.withColumn(name, _remover(width)(text, F.col(runs))).drop(row, runs)


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the hash of the kept words, of every row."""
    found = F.col("found")
    return find_repeats(docs.select("doc_id", "text"), output="found").select(
        "doc_id", found["n_words"].alias("n_words"), found["n_removed"].alias("n_removed"), F.sha2(found["kept"], 256).alias("kept_sha256")
    )


# DuckDB: every window's earliest place, by its words.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), v AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS passage
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY passage ORDER BY doc_id, i) AS n FROM v) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM repeated
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
