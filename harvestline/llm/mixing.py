"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words. A document of a source is wanted target / size of
the source times: once or twice whole, and once more with a probability. Pivotal
rounding settles these probabilities in pairs: words move at random from one document
of a pair to the other until one of them is in or out, and the other goes on with what
is left. Each move keeps the pair's words, and keeps every document's probability in
the mean. So a source misses its target by less than one document, however many it has.

Pairs form a reduction tree. Documents of a source are dealt by hash to chunks of
about ``FAN_IN``; a chunk settles all its documents but one, and the rests of
``FAN_IN`` chunks meet on the next level, up to one rest for each source. Every level
is a group-by on (source, chunk) and a fold over a bounded array, and is written to the
shared folder. The last rest is taken in part: so many of its first words as are left.

Main path and weights are column expressions only; texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, staged, uniform

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
FAN_IN = 64
# Equal rows that one array numbers.
NUMBER_RUN = 1 << 16
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- targets -----------------------------------------------------------------


def _ranked(totals: DataFrame) -> DataFrame:
    """``totals`` with the source's place by code point, null last, numbered per range."""
    ranged = totals.withColumn("void", F.col("source").isNull()).repartitionByRange("void", "source")
    ranged = staged(ranged.withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    # One row a partition, not a source.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("range").orderBy("void", "source")
    return ranged.join(starts, "range").withColumn("place", F.col("start") + F.row_number().over(within) - 1)


def source_targets(
    totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, n, source_size, target) from (source, n, source_size).

    ``share`` of all words is dealt by weight; a target stops at ``most`` times its
    source's size, and the excess is dealt again by weight among the others until no
    target is above. A source without words has target 0.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = _ranked(totals).withColumn("weight", F.get(table, (F.col("place") % len(weights)).cast("int")))
    ranked = staged(ranked.select("source", "n", "source_size", "weight"), "weighted-sources")
    full = F.col("source_size") * F.lit(float(most))
    level = 0.0
    while True:  # each round only adds full sources, so it ends
        stopped = full <= F.lit(level) * F.col("weight")
        sums = ranked.agg(
            F.sum(F.col("source_size").cast("double")).alias("all"),
            F.sum(F.when(stopped, full)).alias("used"),
            F.sum(F.when(~stopped, F.col("weight"))).alias("open"),
        ).first()
        if not sums["open"]:
            break
        higher = (share * (sums["all"] or 0.0) - (sums["used"] or 0.0)) / sums["open"]
        if higher <= level:
            break
        level = higher
    target = F.least(full, F.lit(level) * F.col("weight"))
    return ranked.select("source", "n", "source_size", target.alias("target"))


# --- pivotal rounding --------------------------------------------------------


def _pair(a: Column, b: Column) -> Column:
    """Settle one of two documents (key, w, p): (rest, settled key, whether it is in).

    ``p`` is the probability of one more copy, ``w`` the words that a copy has.
    """
    into_a = F.least(a["w"] * (1 - a["p"]), b["w"] * b["p"])
    into_b = F.least(a["w"] * a["p"], b["w"] * (1 - b["p"]))
    chance = uniform(F.lit(SEED), a["key"], b["key"])
    give_a = (into_a + into_b <= 0) | (chance * (into_a + into_b) < into_b)
    both = a["w"] * a["p"] + b["w"] * b["p"]
    # Moving to a: a is full, or b is empty; moving to b: a is empty, or b is full.
    a_full = a["w"] * (1 - a["p"]) <= b["w"] * b["p"]
    b_full = b["w"] * (1 - b["p"]) <= a["w"] * a["p"]

    def out(rest: Column, words: Column, done: Column, into: bool) -> Column:
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), words / rest["w"]))
        left = F.struct(rest["key"].alias("key"), rest["w"].alias("w"), p.alias("p"))
        return F.struct(left.alias("rest"), done["key"].alias("key"), F.lit(into).alias("into"))

    return F.when(give_a & a_full, out(b, both - a["w"], a, True)).when(give_a, out(a, both, b, False)).when(
        b_full, out(a, both - b["w"], b, True)
    ).otherwise(out(b, both, a, False))


def _fold(items: Column) -> Column:
    """Settle all documents of an array but the last rest: (rest, done)."""
    done = "array<struct<key:struct<h:bigint,id:bigint,size:bigint>,into:boolean>>"
    start = F.struct(F.get(items, 0).alias("rest"), F.array().cast(done).alias("done"))

    def step(state: Column, item: Column) -> Column:
        # An array of one element binds the pair's result to a name, so it is computed once.
        met = F.transform(
            F.array(_pair(state["rest"], item)),
            lambda r: F.struct(
                r["rest"].alias("rest"),
                F.concat(state["done"], F.array(F.struct(r["key"].alias("key"), r["into"].alias("into")))).alias("done"),
            ),
        )
        return F.get(met, 0)

    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, step)


def _settle(items: DataFrame, count: int, fan_in: int) -> DataFrame:
    """(source, key, into, part) for items (source, chunk, key, w, p); part only of last rests."""
    chunks = max(1, -(-count // fan_in))
    level = items.withColumn("chunk", F.pmod(F.col("key.h"), F.lit(chunks)))
    settled: list[DataFrame] = []
    while True:
        grouped = level.groupBy("source", "chunk").agg(
            F.array_sort(F.collect_list(F.struct("key", "w", "p"))).alias("items")
        )
        folded = staged(grouped.select("source", "chunk", _fold(F.col("items")).alias("state")), "mix-level")
        settled.append(folded.select("source", F.explode("state.done").alias("d")).select("source", "d.key", "d.into"))
        level = folded.select("source", "chunk", "state.rest.key", "state.rest.w", "state.rest.p")
        if chunks == 1:
            break
        chunks = -(-chunks // fan_in)
        level = level.withColumn("chunk", F.col("chunk") % chunks)
    out = level.select("source", "key", F.lit(False).alias("into"), (F.col("w") * F.col("p")).alias("part"))
    for frame in settled:
        out = out.unionByName(frame.withColumn("part", F.lit(None).cast("double")))
    return out


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """(id_col, source, size, source_size, target, copies, extra), a row for every row of ``docs``.

    ``copies`` is how often the whole document is taken, ``extra`` how many first words
    once more: more than 0 in one document of a source at most. Null and blank texts
    have size 0 and are not taken. Rows without a source form one source, ranked last.
    Rows that agree in id, source and size are one item with a number: pivotal rounding
    among them is settled at once, so no group of equal rows is gathered. A null id
    is an id. The same rows always give the same mix. An empty table gives none.
    """
    from ..session import broadcast_if_small

    sized = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")
    )
    items = staged(sized.groupBy("source", "id", "size").agg(F.count("*").alias("n")), "mix-items")
    totals = items.groupBy("source").agg(
        F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("source_size")
    )
    targets = staged(source_targets(staged(totals, "mix-sources"), weights, share, most), "mix-targets")
    of = broadcast_if_small(targets.withColumnRenamed("source", "of").drop("n"))
    placed = items.join(of, items["source"].eqNullSafe(of["of"]), "left").drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = F.when(F.col("size") > 0, rate).otherwise(0.0)
    # Equal rows trade among themselves first: so many get one more copy, and one may be left open.
    more = F.col("n") * (F.col("wanted") - F.col("base"))
    placed = placed.withColumn("wanted", wanted).withColumn("base", F.floor("wanted"))
    placed = placed.withColumn("sure", F.floor(more)).withColumn("p", more - F.floor(more))
    key = F.struct(F.xxhash64(F.lit(SEED), "id", "size").alias("h"), "id", "size")
    placed = staged(placed.withColumn("key", key), "mix-placed")
    open_items = placed.where("p > 0").select("source", "key", F.col("size").cast("double").alias("w"), "p")
    settled = staged(_settle(open_items, placed.count(), fan_in), "mix-settled")
    ruled = settled.select(F.col("source").alias("s"), F.col("key.id").alias("i"), F.col("key.size").alias("z"), "into", "part")
    joined = placed.join(
        ruled,
        placed["source"].eqNullSafe(ruled["s"]) & placed["id"].eqNullSafe(ruled["i"]) & (placed["size"] == ruled["z"]),
        "left",
    )
    # Numbers of equal rows in runs, so that no array grows with their count.
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / NUMBER_RUN))).alias("run")
    rows = joined.select("id", "source", "size", "source_size", "target", "base", "sure", "into", "part", "n", run)
    upto = F.least(F.col("n"), (F.col("run") + 1) * NUMBER_RUN)
    number = F.explode(F.sequence(F.col("run") * NUMBER_RUN + 1, upto)).alias("number")
    rows = rows.select("id", "source", "size", "source_size", "target", "base", "sure", "into", "part", number)
    last = F.col("number") == F.col("sure") + 1
    up = (F.col("number") <= F.col("sure")) | (last & F.coalesce("into", F.lit(False)))
    return rows.select(
        F.col("id").alias(id_col),
        "source",
        "size",
        "source_size",
        F.col("target"),
        (F.col("base") + up.cast("long")).alias("copies"),
        F.when(last, F.floor(F.coalesce("part", F.lit(0.0)))).otherwise(0).cast("long").alias("extra"),
    )


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs``."""
    taken = F.col("copies") * F.col("size") + F.col("extra")
    return mix(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it whole; all columns stay.

    The part of one document that a source may take besides is left out.
    """
    mark, copies = free_name(docs, "_number"), free_name(docs, "_copies")
    decided = mix(docs, id_col, text_col, source_col)
    # How many of the rows that agree in id, source and size go in how often.
    decided = decided.groupBy(id_col, "source", "size").agg(
        F.min("copies").alias("low"), (F.sum("copies") - F.min("copies") * F.count("*")).alias("up")
    )
    # Plain keys that null also has, so that the rank below needs no second shuffle.
    names = [free_name(docs, n) for n in ("_id", "_no_id", "_source", "_no_source", "_size")]

    def keys(id_: Column, source: Column, size: Column) -> list[Column]:
        id_, source = id_.cast("long"), source.cast("string")
        return [F.coalesce(id_, F.lit(0)), id_.isNull(), F.coalesce(source, F.lit("")), source.isNull(), size]

    ruled = keys(F.col(id_col), F.col("source"), F.col("size"))
    decided = staged(decided.select(*[c.alias(n) for c, n in zip(ruled, names)], "low", "up"), "mix-copies")
    own = keys(docs[id_col], docs[source_col], word_count(docs[text_col]))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(n) for c, n in zip(own, names)])
    order = Window.partitionBy(*names).orderBy(F.xxhash64(F.col("row")[text_col]), F.col("row")[text_col])
    joined = keyed.join(decided, names).withColumn(mark, F.row_number().over(order))
    often = F.col("low") + (F.col(mark) <= F.col("up")).cast("long")
    repeated = joined.where(often > 0).withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), often)))
    return repeated.select(*[F.col("row")[c].alias(c) for c in docs.columns])
