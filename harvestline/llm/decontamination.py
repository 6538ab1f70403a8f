"""Benchmark passages in documents, by one Aho-Corasick automaton over all test items.

Texts are normalised to words, and every word of a test item becomes one symbol. The
automaton holds all windows of ten consecutive item words, so it finds every window
that occurs in a document, with all overlaps, in one pass over the document's symbols.
A symbol is a word, so matches map back to words and from there to offsets in the
original text. Documents are not shuffled: the items travel to the tasks.

The automaton has a size bound, ``BLOCK_WORDS`` item words. Test items beyond it are
dealt to further blocks, each with an automaton of its own, and documents pass by one
block after the other. The result is the same; only the passes grow.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, free_name, staged, worker_cache

by_value(__name__)

WINDOW = 10
BLOCK_WORDS = 100_000
# Bytes of UTF-8: A-Z to lower case, other ASCII but digits and letters to a blank.
_NORMAL = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if byte >= 0x80 or chr(byte).isalnum() else 32
    for byte in range(256)
)
_WORD = re.compile(rb"[^ ]+")
_UNKNOWN = "\0"
_SURROGATES = 0xD800, 0xE000

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def windows_of(words: list[bytes], width: int = WINDOW) -> list[list[bytes]]:
    """All windows of an item; an item of fewer words, but not none, is one window."""
    if not words:
        return []
    return [words[i : i + width] for i in range(max(1, len(words) - width + 1))]


def _blocks(items: DataFrame, id_col: str, text_col: str, width: int, block_words: int) -> Iterator[dict[tuple, set]]:
    """Windows with their items, in blocks of a bounded size; items come one by one."""
    block: dict[tuple, set] = {}
    size = 0
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    for row in rows.orderBy("id", "text").toLocalIterator():
        for window in windows_of(words_of(row["text"]), width):
            block.setdefault(tuple(window), set()).add(row["id"])
            size += 1
            if size >= block_words:
                yield block
                block, size = {}, 0
    if block:
        yield block


def _symbol(number: int) -> str:
    """A character for a word number from 1, leaving out zero and surrogates."""
    low, high = _SURROGATES
    return chr(number if number < low else number + high - low)


def _automaton(block: list[tuple[tuple, list]]):
    import ahocorasick

    symbols: dict[bytes, str] = {}
    machine = ahocorasick.Automaton()
    for window, ids in block:
        for word in window:
            if word not in symbols:
                symbols[word] = _symbol(len(symbols) + 1)
        machine.add_word("".join(symbols[word] for word in window), (len(window), ids))
    machine.make_automaton()
    return machine, symbols


def _scan_one(text: str | None, machine, symbols: dict[bytes, str]) -> tuple:
    """(n_words, starts, ends, items): word runs that are hit, end exclusive, and the items."""
    words = words_of(text)
    look = symbols.get
    coded = "".join([look(word, _UNKNOWN) for word in words])
    edges = None
    found: set = set()
    for last, (width, ids) in machine.iter(coded) if symbols else ():  # no items make no automaton
        if edges is None:
            edges = np.zeros(len(words) + 1, np.int64)
        edges[last - width + 1] += 1
        edges[last + 1] -= 1
        found.update(ids)
    if edges is None:
        return len(words), [], [], []
    inside = np.diff(np.concatenate(([0], np.cumsum(edges) > 0)).astype(np.int8))
    starts, ends = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    return len(words), starts.tolist(), ends.tolist(), sorted(i for i in found if i is not None)


def _scanner(block: dict[tuple, set]):
    patterns = [(window, sorted(ids, key=lambda i: (i is None, i))) for window, ids in block.items()]
    name = uuid.uuid4().hex

    @F.pandas_udf(FOUND)
    def scan(texts: pd.Series) -> pd.DataFrame:
        kept = worker_cache("automata")
        if name not in kept:
            kept.clear()  # one automaton at a time in a worker
            kept[name] = _automaton(patterns)
        return pd.DataFrame([_scan_one(text, *kept[name]) for text in texts], columns=FOUND.names)

    return scan


def _merge(found: Column, more: Column) -> Column:
    return F.struct(
        more["n_words"].alias("n_words"),
        F.concat(found["starts"], more["starts"]).alias("starts"),
        F.concat(found["ends"], more["ends"]).alias("ends"),
        F.array_union(found["items"], more["items"]).alias("items"),
    )


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    output: str = "found",
) -> DataFrame:
    """``docs`` with a struct ``output``: n_words, n_hit, starts and ends of hit word runs, items.

    Word runs are numbered in words from 0, end exclusive, without overlap if there is
    one block of items; ``n_hit`` counts a word once in any case. ``items`` are the
    ids, as strings in string order, of items with a window in the text. Null and
    wordless texts have no words and no hits; items without words have no window. An
    item without an id hits words but is not listed. Repeated items count once. The
    new column takes the place of no other: a clash gives it underscores at its end.
    """
    name = free_name(docs, output)
    frame = None
    for block in _blocks(items, item_id, item_text, width, block_words):
        scan = _scanner(block)(F.col(text_col).cast("string"))
        if frame is None:
            frame = docs.withColumn(name, scan)
        else:
            frame = staged(frame, "scanned")
            more = free_name(frame, "_more")
            frame = frame.withColumn(more, scan)
            frame = frame.withColumn(name, _merge(F.col(name), F.col(more))).drop(more)
    if frame is None:
        frame = docs.withColumn(name, _scanner({})(F.col(text_col).cast("string")))
    found = F.col(name)
    return frame.withColumn(
        name,
        F.struct(
            found["n_words"].alias("n_words"),
            _covered(found["starts"], found["ends"]).alias("n_hit"),
            found["starts"].alias("starts"),
            found["ends"].alias("ends"),
            F.array_sort(found["items"]).alias("items"),
        ),
    )


def _covered(starts: Column, ends: Column) -> Column:
    """Words in the union of runs, which may overlap between blocks of items."""
    runs = F.array_sort(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))))
    zero = F.lit(0).cast("long")
    state = F.struct(zero.alias("n"), zero.alias("upto"))

    def add(seen: Column, run: Column) -> Column:
        begin = F.greatest(run["s"], seen["upto"])
        return F.struct(
            (seen["n"] + F.greatest(run["e"] - begin, zero)).alias("n"), F.greatest(run["e"], seen["upto"]).alias("upto")
        )

    return F.aggregate(runs, state, add, lambda seen: seen["n"])


def offsets_of(text: str, starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Word runs as code-point offsets in the original text, end exclusive."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(_NORMAL))]
    # Blanks and letters keep their byte, so bytes of the normal form are bytes of the text.
    points = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    before = np.concatenate(([0], points)).tolist()
    return [(before[at[s][0]], before[at[e - 1][1]]) for s, e in zip(starts, ends)]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@F.pandas_udf(SPANS)
def passage_offsets(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Hit passages as offsets in the original text."""
    rows = zip(texts, starts, ends)
    return pd.Series(
        [[{"start": a, "end": b} for a, b in offsets_of(t, s, e)] if len(s) else [] for t, s, e in rows], dtype=object
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit word; all columns stay."""
    name = free_name(docs, "found")
    scanned = find_passages(docs, items, text_col, output=name)
    return scanned.where(F.col(name)["n_hit"] == 0).drop(name)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    found = F.col("found")
    scanned = find_passages(docs.select("doc_id", "text"), items)
    return scanned.select(
        "doc_id",
        found["n_words"].alias("n_words"),
        found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", found["items"]), 256).alias("items_sha256"),
        (found["n_hit"] > 0).alias("contaminated"),
    )


# DuckDB: every item window against every window of the same width in every text.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT item, least(10, len(w)) AS width, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS passage
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, i, width, array_to_string(w[i:i + width - 1], ' ') AS passage
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT width FROM bw)
  WHERE i + width - 1 <= len(w)
), hit AS (
  SELECT DISTINCT r, i, dw.width, item FROM dw JOIN bw USING (width, passage)
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + width)) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
