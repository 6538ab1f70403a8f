"""Near-duplicates by SimHash fingerprints, linked by meet-in-the-middle ball hashing.

Two fingerprints within ``RADIUS`` = 3 bits meet half way. Every distinct fingerprint
emits all variants within half the radius, rounded down: itself and its one-bit
flips. Two variants cover two differing bits; the odd third bit is covered by erasing
one of three bands of bits, once each. So a fingerprint emits 3 x (1 + kept bits) = 131
keys of about 43 bits, and two fingerprints within three bits share at least one key
(erase a band that holds a differing bit: at most two are left, and each side flips
one). Keys meet in one shuffle, and colliding pairs are verified on all 64 bits.

A pair within the radius can share many keys. It is linked under one of them only,
found from the two fingerprints alone, and a key passes on a spanning forest of its
links. So a key with n members yields fewer than n rows, and no link is lost to the
components.

A key with more than ``FULL_RUN`` members (a large group of near copies) isn't
compared pair by pair. Its members emit whole balls instead: all one-bit flips, and
those with an odd number of ones also all flips of two bits of the same half (two of
three differing bits always share a half, and of two fingerprints at an odd distance
exactly one has odd parity). There a variant that lies within one bit of some member
is within three bits of all others, by the triangle inequality, so all link to it; and
no variant can have more members than a ball has points, however large the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import by_value, column_of, free_name, keyed_runs, spread, staged
from .components import connected_components

by_value(__name__)

RADIUS = 3
SEED = 42
SHINGLE = 3
# Bands of bits that are erased in turn: (lowest bit, width).
BANDS = ((0, 22), (22, 21), (43, 21))
# Members of a key up to which they are compared pair by pair.
FULL_RUN = 256
_CHUNK = 1 << 16


# --- fingerprints -----------------------------------------------------------


def fingerprint_of(text: str | None) -> int:
    """SimHash of one text, as a signed 64-bit integer.

    Lower-cases A-Z, splits at ASCII white space, hashes 3-word shingles with XXH64
    and sets the bits that are set in over half the hashes. Fewer words make one
    shingle; no words (or null) give zero.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        shingles = map(b"%b %b %b".__mod__, zip(words, words[1:], words[2:]))
        hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(words) - 2)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _CHUNK):
        part = hashes[start : start + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [fingerprint_of(text.as_py()) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row."""
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(_fingerprints, "id long, fp long")


# --- variants and links -----------------------------------------------------


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _erased(fps: np.ndarray, band: int) -> np.ndarray:
    """The bits outside a band, packed, with the band's number above them."""
    low, width = BANDS[band]
    below = fps & np.uint64((1 << low) - 1)
    above = fps >> np.uint64(low + width) if low + width < 64 else np.zeros_like(fps)
    return (above << np.uint64(low)) | below | np.uint64(band << 60)


def _half_ball(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, fingerprints) of all variants within half the radius."""
    keys = []
    for band, (_, width) in enumerate(BANDS):
        flips = np.concatenate(([0], 1 << np.arange(64 - width, dtype=np.uint64))).astype(np.uint64)
        keys.append((_erased(fps, band)[:, None] ^ flips[None, :]).ravel())
    sizes = [1 + 64 - width for _, width in BANDS]
    return np.concatenate(keys), np.concatenate([np.repeat(fps, n) for n in sizes])


def _full_ball(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, fingerprints, near) of whole balls: near marks those within one bit."""
    ones = np.uint64(1) << np.arange(64, dtype=np.uint64)
    near = np.concatenate((np.zeros(1, np.uint64), ones))
    pairs = [(i, j) for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)]
    far = np.array([(1 << i) | (1 << j) for i, j in pairs], np.uint64)
    odd = fps[_ones(fps) % 2 == 1]
    keys = np.concatenate(((fps[:, None] ^ near).ravel(), (odd[:, None] ^ far).ravel()))
    owners = np.concatenate((np.repeat(fps, len(near)), np.repeat(odd, len(far))))
    return keys, owners, np.arange(len(keys)) < len(fps) * len(near)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _emit_half(batches):
    for batch in batches:
        fps = np.unique(column_of(batch, "fp").to_numpy().view(np.uint64))
        for start in range(0, len(fps), 1024):
            keys, owners = _half_ball(fps[start : start + 1024])
            yield _batch(key=keys, fp=owners)


def _emit_full(batches):
    for batch in batches:
        fps = column_of(batch, "fp").to_numpy().view(np.uint64)
        for start in range(0, len(fps), 256):
            keys, owners, near = _full_ball(fps[start : start + 256])
            yield _batch(key=keys, fp=owners, near=near)


def _own_links(key: np.uint64, members: np.ndarray) -> np.ndarray:
    """Which pairs of a key's members are links that this key is to report."""
    band = int(key >> np.uint64(60))
    apart = members[:, None] ^ members[None, :]
    own = _ones(apart) <= RADIUS
    for earlier in range(band):  # a band before this one that also does the pair
        own &= _ones(_erased(apart, earlier) & np.uint64((1 << 60) - 1)) > 2
    kept = _erased(members, band)
    differ = kept[:, None] ^ kept[None, :]
    first = differ & (~differ + np.uint64(1))
    count = _ones(differ)
    one = np.minimum(kept[:, None], kept[None, :])
    two = np.minimum(kept[:, None] ^ first, kept[None, :] ^ first)
    return own & (np.where(count == 2, two, one) == key) & (count <= 2)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Tree links that keep the components of a small adjacency matrix."""
    left, found = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            node = front.pop()
            for other in np.flatnonzero(linked[node] & left):
                left[other] = False
                found.append((node, int(other)))
                front.append(int(other))
    return found


def _links_of(key: np.uint64, members: np.ndarray) -> list[tuple[int, int]]:
    if len(members) == 2:  # most keys that collide at all
        return [(0, 1)] if _own_links(key, members)[0, 1] else []
    return _forest(_own_links(key, members))


def _verify(full_run: int):
    """Links of the keys of a sorted partition; members of longer runs, marked by a null end."""

    def verified(batches):
        a, b, open_key, run = [], [], None, []
        crowded = False

        def flush():
            nonlocal run, crowded
            if not crowded and len(run) > 1:
                members = np.array(run, np.uint64)
                for i, j in _links_of(np.uint64(open_key), members):
                    a.append(run[i])
                    b.append(run[j])
            run, crowded = [], False

        def out():
            ends = [pa.array(np.array(a, np.uint64).view(np.int64)), pa.array([x if x is None else x - (1 << 64) * (x >> 63) for x in b], pa.int64())]
            a.clear()
            b.clear()
            return pa.RecordBatch.from_arrays(ends, ["a", "b"])

        for batch in batches:
            keys = column_of(batch, "key").to_numpy().view(np.uint64)
            fps = column_of(batch, "fp").to_numpy().view(np.uint64)
            same = keys[1:] == keys[:-1]
            # Rows that share their key with a neighbour; all others matter only at the batch's ends.
            matter = np.concatenate((same, [True])) | np.concatenate(([True], same))
            for key, fp in zip(keys[matter].tolist(), fps[matter].tolist()):
                if key != open_key:
                    flush()
                    open_key = key
                if crowded:
                    a.append(fp)
                    b.append(None)
                    continue
                run.append(fp)
                if len(run) > full_run:
                    a.extend(run)
                    b.extend([None] * len(run))
                    run, crowded = [], True
            if len(a) >= 10_000:
                yield out()
        flush()
        yield out()

    return verified


def _stars(batches):
    """Members of a full-ball variant, linked to one that is within a bit of it."""
    for _, (fps, near) in keyed_runs(batches, "key", ["fp", "near"]):
        if near.any():
            hub = fps[near].min()
            others = np.unique(fps[fps != hub])
            if len(others):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(others), hub)), pa.array(others)], ["a", "b"])


def ball_links(marks: DataFrame, full_run: int = FULL_RUN) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` as all pairs within the radius do."""
    met = spread(marks, "fp").mapInArrow(_emit_half, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = staged(met.mapInArrow(_verify(full_run), "a long, b long"), "ball-links")
    crowded = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    balls = spread(crowded, "fp").mapInArrow(_emit_full, "key long, fp long, near boolean")
    stars = balls.repartition("key").sortWithinPartitions("key").mapInArrow(_stars, "a long, b long")
    return found.where("b is not null").unionByName(stars)


# --- groups -----------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", full_run: int = FULL_RUN) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` is 16 hex digits; ``component_id`` is the smallest id that links
    of at most three differing bits reach. Null, empty and blank texts have the
    fingerprint zero and are linked like any other. Equal texts, and so repeated
    rows, have equal fingerprints and one component; a repeated id stays repeated. A
    null id is never a component's id; a component without any id has a null one.
    Other columns are not read. An empty table gives an empty one.
    """
    marked = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    # One row a fingerprint before anything is compared: copies take no part in it.
    distinct = staged(marked.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    roots = staged(connected_components(ball_links(distinct.select("fp"))), "roots")
    lows = roots.join(distinct, roots["node"] == distinct["fp"]).groupBy("root").agg(F.min("low").alias("group_low"))
    grouped = staged(roots.join(lows, "root").select(F.col("node").alias("fp"), "group_low"), "grouped")
    named = staged(
        distinct.join(grouped, "fp", "left").select("fp", F.coalesce("group_low", "low").alias("component_id")),
        "components",
    )
    return marked.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their group; all columns stay.

    Of rows that repeat such an id, one stays: the smallest by hash of the text, then
    text. Rows without an id can't name a group and all stay.
    """
    groups = near_duplicates(docs, id_col, text_col)
    kept = groups.where(F.col("component_id") == F.col(id_col)).select(id_col).distinct()
    named = docs.join(staged(kept, "representatives"), id_col, "left_semi")
    rank = free_name(docs, "_rank")
    order = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), text_col)
    first = named.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)
    return first.unionByName(docs.where(F.col(id_col).isNull()))
