"""Text-match joins stated as equi-joins.

"Contains", "whole word" and "LIKE" joins are theta joins; run as such they
compare every row with every row. Each is rewritten here as an equi-join on a
key that any true match must share, followed by the exact test. The table of
terms, aliases or rules is broadcast only after a count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD_CHAR, entity, intent_by_keywords
from ..session import MAX_FOLDED_ROWS, broadcast_if_small, small_rows, stage

GRAM = 3


def _longest(pieces: Column) -> Column:
    """The longest string of an array; the first in sort order among equals."""
    ranked = F.array_sort(F.transform(pieces, lambda p: F.struct(-F.length(p), p.alias("p"))))
    return ranked[0]["p"]


def like_pattern(term: Column) -> Column:
    """``%term%`` with ``%`` and ``_`` in the term kept as wildcards."""
    escaped = F.replace(term, F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit("%"), escaped, F.lit("%"))


def join_same(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", small: bool = False
) -> DataFrame:
    """Equi-join where NULL equals NULL; the key columns are kept once.

    ``small`` asks for a broadcast of ``right``, whose size was checked.
    """
    other = right.withColumnsRenamed({key: f"_same_{key}" for key in keys})
    equal = [F.col(key).eqNullSafe(F.col(f"_same_{key}")) for key in keys]
    joined = left.join(F.broadcast(other) if small else other, equal, how)
    return joined.drop(*(f"_same_{key}" for key in keys))


def contains_pairs(terms: DataFrame, values: DataFrame, term: str, value: str) -> DataFrame:
    """Distinct (term, value) where ``value ILIKE '%term%'``.

    Join key: the longest wildcard-free piece of the term against the
    substrings of the value that have a length some key has. Use it on distinct
    dimension values, not on facts.
    """
    keyed = (
        terms.select(term)
        .where(F.col(term).isNotNull())
        .distinct()
        .withColumn("_key", _longest(F.split(F.lower(term), "[%_]")))
    )
    lengths = keyed.agg(F.collect_set(F.length("_key")).alias("n")).scalar()
    lowered = F.lower(value)
    pieces = F.flatten(
        F.transform(
            F.col("_lengths"),
            lambda n: F.when(n == 0, F.array(F.lit(""))).when(
                n <= F.length(lowered),
                F.transform(
                    F.sequence(F.lit(1), F.length(lowered) - n + 1),
                    lambda start: F.substring(lowered, start, n),
                ),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    pieced = (
        values.select(value)
        .where(F.col(value).isNotNull())
        .distinct()
        .withColumn("_lengths", lengths)
        .select(value, F.explode(F.array_distinct(pieces)).alias("_key"))
    )
    return (
        pieced.join(keyed, "_key")
        .where(F.call_function("ilike", F.col(value), like_pattern(F.col(term))))
        .select(term, value)
    )


def _candidates(
    texts: DataFrame, named: DataFrame, key: str, text: str, keys: Callable[[Column], Column]
) -> DataFrame:
    """(key, columns of ``named``, _text) of texts that share a key with a named row.

    ``named`` has all keys that a match must share as ``_keys``, and meets the texts
    by the one that the fewest of them have, so a frequent word or gram makes no
    hot key unless a row has no other. Texts are read once: their (id, key) pairs
    that any row asks for are stored, counted and joined, and only candidates meet
    their text, by id. The text is folded once, not per key. ``key`` is unique.
    """
    folded = texts.select(key, F.lower(text).alias("_text"))
    named = stage(named.withColumn("_row", F.monotonically_increasing_id()), "named")
    asked = named.select("_row", F.explode("_keys").alias("_key"))
    wanted = broadcast_if_small(stage(asked.select("_key").distinct(), "keys"))
    exploded = folded.select(key, F.explode(F.array_distinct(keys(F.col("_text")))).alias("_key"))
    found = stage(exploded.join(wanted, "_key"), "found-keys")
    counts = found.groupBy("_key").agg(F.count("*").alias("_n"))
    rarest = asked.join(counts, "_key", "left").groupBy("_row").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_key").alias("k")))["k"].alias("_key")
    )
    keyed = stage(named.drop("_keys").join(rarest, "_row").drop("_row"), "keyed")
    pairs = found.join(broadcast_if_small(keyed), "_key").drop("_key")
    other = folded.withColumnRenamed(key, "_id")
    return pairs.join(other, pairs[key].eqNullSafe(other["_id"])).drop("_id")


def word_pairs(texts: DataFrame, aliases: DataFrame, key: str, text: str) -> DataFrame:
    """(key, alias columns) for every alias that is a whole word of the text.

    Join keys: the runs of letters, digits or underscores in the alias. In a
    true match each is bounded on both sides, so it is one of the runs of the
    text. An alias without any such run is tested against every text.
    """
    run = f"([{WORD_CHAR}]+)"
    runs_of = F.regexp_extract_all("alias", F.lit(run))
    none = F.array(F.lit(""))
    named = aliases.where(F.col("alias").isNotNull()).withColumn(
        "_keys", F.when(F.size(runs_of) > 0, F.array_distinct(runs_of)).otherwise(none)
    )
    bare = not named.where(F.array_contains("_keys", "")).isEmpty()

    def runs(lowered: Column) -> Column:
        found = F.regexp_extract_all(lowered, F.lit(run))
        return F.array_append(found, F.lit("")) if bare else found

    quoted = F.concat(F.lit("\\Q"), F.col("alias"), F.lit("\\E"))
    pattern = F.concat(
        F.lit(f"(^|[^{WORD_CHAR}])("), quoted, F.lit(f")($|[^{WORD_CHAR}])")
    )
    found = _candidates(texts, named, key, text, runs)
    return found.where(F.rlike(F.col("_text"), pattern)).drop("_text")


def _grams(text: Column, n: int) -> Column:
    """All substrings of ``n`` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)


def keyword_pairs(texts: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rule columns) for every rule whose keyword occurs in the text.

    Join keys: the grams of three characters of the keyword (the whole keyword if
    shorter) against those of the text. An empty keyword occurs in every
    text, a NULL one in none.
    """
    keyword = F.col("keyword")
    grams_of = F.when(F.length(keyword) <= GRAM, F.array(keyword)).otherwise(F.array_distinct(_grams(keyword, GRAM)))
    named = rules.where(keyword.isNotNull()).withColumn("_keys", grams_of)
    width = F.least(F.length(keyword), F.lit(GRAM))
    lengths = [row["n"] for row in named.select(width.alias("n")).distinct().collect()]  # 0 to GRAM

    def grams(lowered: Column) -> Column:
        none = F.array().cast("array<string>")
        found = (
            _grams(lowered, n) if n else F.when(lowered.isNotNull(), F.array(F.lit("")))
            for n in sorted(lengths)
        )
        return F.concat(none, *found)

    found = _candidates(texts, named, key, text, grams)
    return found.where(F.col("_text").contains(keyword)).drop("_text")


def ranked(order: Column, value: Column) -> Column:
    """What the first of several matches is the smallest of: order, NULL last, then value, NULL last."""
    return F.struct(order.isNull().alias("o"), order.alias("order"), value.isNull().alias("v"), value.alias("value"))


def _rank(order, value) -> tuple:
    """The same for rows that are folded into a projection."""
    return order is None, order or 0, value is None, value or ""


def first_by(matches: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The value with the lowest order per key, NULL last; the smallest value among equals.

    Only matched rows reach this; each key has at most one row per rule.
    """
    return matches.groupBy(*keys).agg(F.min(ranked(F.col(order), F.col(value))).alias("_first")).select(
        *keys, F.col("_first")["value"].alias(value)
    )


def entities_by_gazetteer(
    questions: DataFrame,
    gazetteer: DataFrame,
    key: str = "qid",
    text: str = "question",
    default_commodity: str | None = None,
    max_folded: int = MAX_FOLDED_ROWS,
) -> DataFrame:
    """(key, commodity, location) of every question from an alias table.

    A small table is folded into the projection; a larger one is joined. Both
    take the lowest ``ord``, NULL last, and the smallest canonical name among
    equals. Rows without an alias match nothing.
    """
    rows = small_rows(gazetteer.where(F.col("alias").isNotNull()), max_folded)
    if rows is not None:
        rows.sort(key=lambda row: _rank(row["ord"], row["canonical"]))
        names = {
            kind: [(row["alias"], row["canonical"]) for row in rows if row["kind"] == kind]
            for kind in ("commodity", "location")
        }
        question = F.col(text)
        return questions.select(
            key,
            F.coalesce(
                entity(question, names["commodity"], default_commodity), F.lit(default_commodity).cast("string")
            ).alias("commodity"),
            entity(question, names["location"]).alias("location"),
        )
    found = word_pairs(questions, gazetteer, key, text)

    def first(kind: str) -> Column:
        return F.min(F.when(F.col("kind") == kind, ranked(F.col("ord"), F.col("canonical"))))["value"]

    named = found.groupBy(key).agg(
        first("commodity").alias("commodity"), first("location").alias("location")
    )
    return questions.select(key).join(named, key, "left").withColumn(
        "commodity", F.coalesce("commodity", F.lit(default_commodity).cast("string"))
    )


def intent_by_rules(
    questions: DataFrame,
    rules: DataFrame,
    default: str,
    key: str = "qid",
    text: str = "question",
    max_folded: int = MAX_FOLDED_ROWS,
) -> DataFrame:
    """(key, intent) of every question from a rule table.

    A small table is folded into the projection; a larger one is joined. Both
    take the lowest priority, NULL last, and the smallest label among equals.
    """
    rows = small_rows(rules, max_folded)
    if rows is not None:
        folded = [(row["priority"], row["keyword"], row["label"]) for row in rows if row["keyword"] is not None]
        folded.sort(key=lambda rule: _rank(rule[0], rule[2]))
        places = {pair: i for i, pair in enumerate(dict.fromkeys((p, label) for p, _, label in folded))}
        folded = [(places[p, label], keyword, label) for p, keyword, label in folded]
        named = intent_by_keywords(F.col(text), folded, default)
        return questions.select(key, F.coalesce(named, F.lit(default)).alias("intent"))
    found = first_by(keyword_pairs(questions, rules, key, text), [key], "priority", "label")
    return questions.select(key).join(found, key, "left").select(
        key, F.coalesce("label", F.lit(default)).alias("intent")
    )
