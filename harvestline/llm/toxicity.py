"""Toxicity by a classifier chain of linear models on hashed words.

Categories are predicted one after the other. Each is a logistic regression on the
words and beginnings of words that a text holds, and on the probabilities of the categories before it. While
the chain is trained those probabilities are out of fold, so that a later model sees
earlier ones as they will be on new texts, not as they are on texts they have learnt.

The models are fitted on a bounded sample of labelled documents. Scoring is one pass
over all whole texts that shuffles nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, free_name, staged
from .decontamination import words_of

by_value(__name__)

# Labelled documents that the chain is trained on at most. If there are more, this share of
# them is dealt out alike among the combinations of categories, so that rare ones are seen.
TRAIN_ROWS = 6_000
EVEN_SHARE = 0.25
# Bytes of a word's beginning.
BEGINNINGS = (4, 5)
_SIGNS = re.compile(rb"[!-/:-@\[-`{-~]{2,}| [|] ")
FOLDS = 3
EPOCHS = 5
# A slot is used if so many documents hold it and the classes differ by so many standard errors.
LEAST_DOCUMENTS = 8
LEAST_Z = 5.0
RATE = 0.3
RIDGE = 1e-5
# Logits of earlier categories are clipped to this before they feed later models.
STEEPEST = 4.0


def words_at(text: str | None) -> np.ndarray:
    """Slots of the distinct words of a text, of how they begin, and of its runs of signs.

    A word's beginning stands for its inflected forms, also those not seen before.
    """
    words = set(words_of(text))
    seen = words.copy()
    for size in BEGINNINGS:
        seen.update(b"^" + word[:size] for word in words if len(word) > size)
    seen.update(run[:4] for run in set(_SIGNS.findall((text or "").encode("utf-8", "surrogatepass"))))
    return np.unique(np.fromiter(map(zlib.crc32, seen), np.uint32, len(seen)))


def _logit(p: np.ndarray | float) -> np.ndarray | float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.clip(np.log(p / (1 - p)), -STEEPEST, STEEPEST) / STEEPEST


def held_slots(slots: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of ``slots`` a text has; both are in ascending order."""
    if not len(at):
        return np.zeros(len(slots), bool)
    return at[np.minimum(np.searchsorted(at, slots), len(at) - 1)] == slots


@dataclass(frozen=True)
class Linear:
    """Weights of the telling slots, in their order, of earlier categories, and an intercept."""

    slots: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float

    def probability(self, at: np.ndarray, earlier: np.ndarray) -> float:
        score = self.weights[held_slots(self.slots, at)].sum() + earlier @ self.earlier + self.intercept
        return float(1 / (1 + np.exp(-np.clip(score, -500, 500))))


def telling(rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Slots whose share of documents differs between the classes beyond chance, in ascending order.

    A long text holds thousands of words that tell nothing; their weights would add up.
    Slots are all 32 bits of a hash: in fewer, such a text would hold a telling one by chance.
    """
    slots, place = np.unique(np.concatenate(rows), return_inverse=True)
    toxic = np.repeat(target, [len(at) for at in rows])
    with_it, without = (np.bincount(place, weights, len(slots)) for weights in (toxic, 1 - toxic))
    n1, n0 = target.sum(), len(target) - target.sum()
    both = (with_it + without) / (n1 + n0)
    spread = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n1 + 1 / n0))
    z = np.where(with_it + without >= LEAST_DOCUMENTS, (with_it / n1 - without / n0) / spread, 0.0)
    return slots[np.abs(z) > LEAST_Z]


def fit_linear(rows: list[np.ndarray], earlier: np.ndarray, target: np.ndarray, weight: np.ndarray) -> Linear:
    """Logistic regression on telling slots by adaptive gradient steps, in a fixed order.

    ``weight`` tells how many labelled documents a row stands for; it moves the
    intercept from the classes' shares of the rows to their shares of all labels.
    One class alone gives its own prior; no rows at all give a low one.
    """
    prior = (target.sum() + 0.5) / (len(target) + 2)
    extra = np.zeros(earlier.shape[1] + 1)
    extra[-1] = np.log(prior / (1 - prior))
    if not len(target) or target.min() == target.max():
        return Linear(np.zeros(0, np.uint32), np.zeros(0), extra[:-1], extra[-1])
    slots = telling(rows, target)
    rows = [np.flatnonzero(held_slots(slots, at)) for at in rows]
    weights, squares, extra_squares = np.zeros(len(slots)), np.ones(len(slots)), np.ones(len(extra))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at = rows[i]
            given = np.append(earlier[i], 1.0)
            score = weights[at].sum() + given @ extra
            off = 1 / (1 + np.exp(-np.clip(score, -500, 500))) - target[i]
            slope = off + RIDGE * weights[at]
            squares[at] += off * off
            weights[at] -= RATE * slope / np.sqrt(squares[at])
            extra_squares += (off * given) ** 2
            extra -= RATE * off * given / np.sqrt(extra_squares)
    moved = np.log(weight[target == 1].mean() / weight[target == 0].mean())
    return Linear(slots, weights, extra[:-1], float(extra[-1] + moved))


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    models: tuple[Linear, ...]
    thresholds: tuple[float, ...]

    def probabilities(self, text: str | None) -> list[float]:
        at = words_at(text)
        found: list[float] = []
        for model in self.models:
            earlier = np.array([_logit(p) for p in found])
            found.append(model.probability(at, earlier))
        return found


def _best_threshold(p: np.ndarray, target: np.ndarray, weight: np.ndarray) -> float:
    """Where out-of-fold predictions have their best F1; 0.5 if there is one class."""
    if not len(target) or target.min() == target.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum((weight * target)[order])
    f1 = 2 * hits / (np.cumsum(weight[order]) + (weight * target).sum())
    best = int(np.argmax(f1))
    after = p[order[best + 1]] if best + 1 < len(p) else 0.0
    return float((p[order[best]] + after) / 2)


def fit_chain(rows: list[np.ndarray], folds: np.ndarray, targets: dict[str, np.ndarray], weight: np.ndarray | None = None) -> Chain:
    """Fit the categories of ``targets`` in their order; ``folds`` numbers each row's fold."""
    weight = np.ones(len(rows)) if weight is None else weight
    earlier = np.zeros((len(rows), 0))
    models, thresholds = [], []
    for target in targets.values():
        unseen = np.zeros(len(rows))
        for fold in range(FOLDS):
            learn, hold = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
            part = fit_linear([rows[i] for i in learn], earlier[learn], target[learn], weight[learn])
            unseen[hold] = [part.probability(rows[i], earlier[i]) for i in hold]
        models.append(fit_linear(rows, earlier, target, weight))
        thresholds.append(_best_threshold(unseen, target, weight))
        earlier = np.column_stack((earlier, _logit(unseen)))
    return Chain(tuple(targets), tuple(models), tuple(thresholds))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = [words_at(text.as_py()).astype("<u4").tobytes() for text in batch.column(0)]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(slots, pa.binary())], ["h", "marks", "at"])


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    train_rows: int = TRAIN_ROWS,
) -> Chain:
    """A chain of ``categories``, name to condition on ``labels``, in their order.

    All labelled documents are taken if they are ``train_rows`` at most. Of more, each
    combination of categories gives some, those of the smallest hashes of their id. A
    document with several labels has a category if one of them says so, and so have
    equal texts; labels without an id, with an unknown (null) condition, or without a
    document teach nothing and take no one's place.
    """
    marks = F.array(*[condition.cast("double") for condition in categories.values()])
    known = labels.select(F.col(id_col).cast("long").alias("i"), marks.alias("marks"))
    known = known.where(F.col("i").isNotNull() & F.forall("marks", lambda m: m.isNotNull()))
    each = F.array(*[F.max(F.get("marks", i)) for i in range(len(categories))])
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("text"))
    known = known.groupBy("i").agg(each.alias("marks")).join(texts.select(F.col("d").alias("i")), "i", "left_semi")
    known = staged(known, "labels")
    sample, stands_for = _sample(known, train_rows)
    # The sample has at most train_rows rows of a few numbers each.
    joined = texts.join(F.broadcast(sample), F.col("d") == F.col("i"))
    seen = joined.select("text", F.xxhash64("text").alias("h"), "marks").mapInArrow(
        _sampled, "h long, marks array<double>, at binary"
    )
    rows = seen.groupBy("h").agg(each.alias("marks"), F.max("at").alias("at")).orderBy("h").limit(train_rows).collect()
    targets = np.array([r["marks"] for r in rows], float).reshape(len(rows), len(categories))
    folds = np.array([r["h"] % FOLDS for r in rows], int)
    slots = [np.frombuffer(r["at"], "<u4") for r in rows]
    weight = np.array([stands_for.get(tuple(r["marks"]), 1.0) for r in rows])
    return fit_chain(slots, folds, {name: targets[:, i] for i, name in enumerate(categories)}, weight)


def _sample(known: DataFrame, train_rows: int) -> tuple[DataFrame, dict[tuple, float]]:
    """Some of the labelled ids (i, marks), and how many ids a taken one stands for, by combination."""
    counts = {tuple(r["marks"]): r["n"] for r in known.groupBy("marks").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if total <= train_rows:
        return known, {}
    even, share = EVEN_SHARE * train_rows / len(counts), (1 - EVEN_SHARE) * train_rows / total
    taken = {marks: min(n, max(1, int(even + share * n))) for marks, n in counts.items()}
    # One bounded top list a combination, so none is gathered in one task.
    first = [known.where(F.col("marks") == F.array(*map(F.lit, marks))).orderBy(F.xxhash64("i"), "i").limit(n) for marks, n in taken.items()]
    return reduce(DataFrame.unionByName, first), {marks: counts[marks] / n for marks, n in taken.items()}


def predict(chain: Chain, docs: DataFrame, text_col: str = "text", output: str = "categories") -> DataFrame:
    """``docs`` with a struct ``output``: the probability of each category, and a flag for each.

    Null and empty texts have no words and get the models' intercepts. Equal texts get
    equal probabilities. The new column gets underscores at its end if its name is taken.
    """
    names = list(chain.categories)
    kind = T.StructType([T.StructField(name, T.DoubleType()) for name in names])
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(chain)  # the telling slots of a bounded sample

    @F.pandas_udf(kind)
    def score(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.probabilities(text) for text in texts], columns=names)

    name = free_name(docs, output)
    scored = docs.withColumn(name, score(F.col(text_col).cast("string")))
    flags = [(F.col(name)[c] >= t).alias(f"is_{c}") for c, t in zip(names, chain.thresholds)]
    return scored.withColumn(name, F.struct(*[F.col(name)[c].alias(f"p_{c}") for c in names], *flags))


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_low_quality, p_toxic and toxic (true) of the documents found toxic."""
    chain = train(docs, labels, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    found = F.col("categories")
    scored = predict(chain, docs.select("doc_id", "text")).where(found["is_toxic"])
    return scored.select("doc_id", found["p_low_quality"].alias("p_low_quality"), found["p_toxic"].alias("p_toxic"), found["is_toxic"].alias("toxic"))
