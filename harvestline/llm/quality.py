"""Quality classifier from weak labels: no labelled document is needed.

Overlapping heuristic labellers look at every text and vote good or bad, or abstain.
Expectation-maximisation over the counts of vote patterns, of which there are few
whatever the corpus, estimates how accurate each labeller is, and so the probability
of "good" for each pattern. These posterior labels train a linear scorer on hashed
word shapes, which then judges every text, also where all labellers abstain.

Two passes read the texts: one for the votes of all documents, one for the scores.
Neither shuffles texts. Only vote counts and a bounded sample of feature rows reach
the driver.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, free_name, staged, worker_cache

by_value(__name__)

# Rows that the scorer is trained on at most; votes are counted over all documents.
TRAIN_ROWS = 6_000
DIMENSIONS = 2_048
EM_ROUNDS = 100
STEPS = 300
RIDGE = 1e-4
THRESHOLD = 0.5
# Word shapes that a worker remembers.
MAX_KNOWN = 200_000
START_PRIOR = 0.8
# Bad, abstain, good: how labellers are taken to vote on bad and on good texts at first.
START_VOTES = np.array([[0.30, 0.01], [0.65, 0.49], [0.05, 0.50]])

# A labeller does not apply to a text of too few words for its shares; that is no abstention.
GOOD, BAD, ABSTAIN, NOT_FOR_IT = "+", "-", "0", "?"
FEW_WORDS = 8

# Frequent function words of the four languages.
FUNCTION_WORDS = frozenset(
    word.encode()
    for word in (
        "the of and to in is it that for was on are as with his they at be this from have or by one had not but what "
        "le la les des du un une et est dans que qui pour par sur au aux ne pas ce se en "
        "der die das und ist von den mit sich auf für im dem nicht ein eine als auch es an zu "
        "el los las una y con del se lo como más pero sus su al de"
    ).split()
)
_SHAPES = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 0x80 else ord("0") if 48 <= b <= 57 else b
    for b in range(256)
)
_RUNS = re.compile(rb"(.)\1+")
_MARKED = re.compile(rb"[*#$%&~^=_+<>{}@/\\]{2,}$")


@dataclass(frozen=True)
class Look:
    """What the labellers and the scorer see of a text."""

    words: int
    slots: dict[int, int]  # words by hashed shape
    marked: float  # words that end in a run of symbols
    shouted: float  # words without a lower-case letter, or with repeated exclamation marks
    barred: float  # words that are one separator sign
    repeated: float  # words equal to the one before
    function: float  # function words
    stopped: float  # words that end in a full stop or comma
    length: float  # mean length of a word
    distinct: float  # distinct words among the first to last, by the square root of their number
    same_lines: float  # lines equal to an earlier one


def _kind(shape: bytes) -> tuple[int, bool, bool, bool, bool]:
    """Slot of a word shape among the features; marked, shouted, barred, stopped."""
    barred = len(shape) == 1 and shape in b"|>*-"
    return (
        zlib.crc32(_RUNS.sub(rb"\1\1", shape)[:24]) % DIMENSIONS,
        not barred and _MARKED.search(shape) is not None,
        (len(shape) > 1 and b"a" not in shape and b"A" in shape) or b"!!" in shape,
        barred,
        shape[-1:] in (b".", b","),
    )


def look_at(text: str | None) -> Look:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return Look(0, {}, *([0.0] * 9))
    known = worker_cache("shapes")
    if len(known) > MAX_KNOWN:
        known.clear()
    slots: dict[int, int] = {}
    marked = shouted = barred = stopped = 0
    for shape, count in Counter(raw.translate(_SHAPES).split()).items():
        kind = known.get(shape)
        if kind is None:
            kind = _kind(shape)
            if len(shape) < 40:
                known[shape] = kind
        slot, is_marked, is_shouted, is_barred, is_stopped = kind
        slots[slot] = slots.get(slot, 0) + count
        marked += is_marked * count
        shouted += is_shouted * count
        barred += is_barred * count
        stopped += is_stopped * count
    lines = raw.split(b"\n")
    return Look(
        n,
        slots,
        marked / n,
        shouted / n,
        barred / n,
        sum(map(eq, words, words[1:])) / n,
        sum(map(FUNCTION_WORDS.__contains__, words)) / n,
        stopped / n,
        len(raw) / n,
        len(set(words)) / max(1.0, n**0.5),
        1 - len(set(lines)) / len(lines),
    )


# Each sees one side of a text; they overlap, err and abstain.
LABELLERS = (
    lambda k: BAD if k.marked > 0.2 else ABSTAIN,
    lambda k: BAD if k.shouted > 0.3 else ABSTAIN,
    lambda k: BAD if k.barred > 0.15 else ABSTAIN,
    lambda k: BAD if k.repeated > 0.25 else ABSTAIN,
    lambda k: BAD if k.words >= 60 and k.distinct < 2 else ABSTAIN,
    lambda k: BAD if k.same_lines > 0.6 else ABSTAIN,
    lambda k: BAD if k.words == 0 or k.length > 25 else ABSTAIN,
    lambda k: (GOOD if k.function > 0.08 else BAD if k.function == 0 else ABSTAIN) if k.words >= FEW_WORDS else NOT_FOR_IT,
    lambda k: (GOOD if 0.04 < k.stopped < 0.5 else BAD if k.stopped == 0 else ABSTAIN) if k.words >= FEW_WORDS else NOT_FOR_IT,
    lambda k: GOOD if k.words and k.marked + k.shouted + k.barred + k.repeated < 0.05 else ABSTAIN,
)


def votes_of(seen: Look) -> str:
    return "".join(labeller(seen) for labeller in LABELLERS)


def features_of(seen: Look) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word shapes by the square root of their share, and a few shares in tenths."""
    values = {slot: (count / seen.words) ** 0.5 for slot, count in seen.slots.items()}
    for name in ("marked", "shouted", "barred", "repeated", "same_lines"):
        slot = zlib.crc32(f"{name}:{round(10 * getattr(seen, name))}".encode()) % DIMENSIONS
        values[slot] = values.get(slot, 0.0) + 1.0
    at = sorted(values)
    return np.array(at), np.array([values[i] for i in at], np.float32)


# --- expectation-maximisation -------------------------------------------------


@dataclass(frozen=True)
class LabelModel:
    """How often a document is good, and how a labeller votes on good and on bad ones."""

    prior: float
    # (labeller, vote, class): probability of bad, abstain, good given the class (0 bad, 1 good)
    tables: np.ndarray

    def posterior(self, patterns: list[str]) -> np.ndarray:
        codes = _codes(patterns)
        # A labeller that doesn't apply gives no evidence.
        logs = np.concatenate((np.log(self.tables), np.zeros((len(LABELLERS), 1, 2))), axis=1)
        score = np.log([1 - self.prior, self.prior]) + sum(logs[i, codes[:, i]] for i in range(len(LABELLERS)))
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))

    def accuracies(self) -> np.ndarray:
        """How often each labeller is right when it votes."""
        weight = np.array([1 - self.prior, self.prior])
        right = self.tables[:, 0, 0] * weight[0] + self.tables[:, 2, 1] * weight[1]
        return right / (self.tables[:, [0, 2], :] @ weight).sum(axis=1)


def _codes(patterns: list[str]) -> np.ndarray:
    order = {BAD: 0, ABSTAIN: 1, GOOD: 2, NOT_FOR_IT: 3}
    return np.array([[order[v] for v in p] for p in patterns], int).reshape(len(patterns), len(LABELLERS))


def fit_labels(counts: dict[str, int]) -> LabelModel:
    """EM over vote patterns and their numbers of documents.

    Starts from labellers that are right more often than not, and a pseudo-count of
    the same keeps classes from changing places. No documents give the start.
    """
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], float)
    codes = _codes(patterns)
    start = np.repeat(START_VOTES[None], len(LABELLERS), axis=0)
    model = LabelModel(START_PRIOR, start)
    total = weight.sum()
    for _ in range(EM_ROUNDS if total else 0):
        good = model.posterior(patterns)
        tables = start.copy()
        for i in range(len(LABELLERS)):
            for vote in range(3):
                at = codes[:, i] == vote
                tables[i, vote] += [weight[at] @ (1 - good[at]), weight[at] @ good[at]]
        tables /= tables.sum(axis=1, keepdims=True)
        settled = np.allclose(tables, model.tables, atol=1e-7)
        model = LabelModel(float((weight @ good + START_PRIOR) / (total + 1)), tables)
        if settled:
            break
    return model


# --- scorer -------------------------------------------------------------------


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, prior: float) -> np.ndarray:
    """Weights, and an intercept at the end, of a logistic regression on soft labels."""
    weights = np.zeros(DIMENSIONS + 1, np.float64)
    weights[-1] = np.log(prior / (1 - prior))
    if not rows:
        return weights
    dense = np.zeros((len(rows), DIMENSIONS + 1), np.float32)
    dense[:, -1] = 1
    for row, (at, values) in zip(dense, rows):
        row[at] = values
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):  # Adam on all rows
        off = 1 / (1 + np.exp(-(dense @ weights.astype(np.float32)).astype(np.float64))) - target
        slope = (off.astype(np.float32) @ dense) / len(rows) + RIDGE * weights
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        weights -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        patterns, at, values = [], [], []
        for text, picked in zip(batch.column(0), batch.column(2).to_pylist()):
            seen = look_at(text.as_py())
            patterns.append(votes_of(seen))
            pair = features_of(seen) if picked else (None, None)
            at.append(pair[0])
            values.append(pair[1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(patterns), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
            ["h", "pattern", "at", "values"],
        )


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        seen = look_at(text)
        if not seen.words:
            return 0.0
        at, values = features_of(seen)
        return float(1 / (1 + np.exp(-(values.astype(np.float64) @ self.weights[at] + self.weights[-1]))))


def fit_quality(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Label model from the votes on all of ``docs``; scorer from ``train_rows`` texts at most.

    The sample is that of the smallest text hashes, each text once, so it does not
    depend on the partitions. An empty table gives a model that keeps what has words.
    """
    share = min(1.0, 1.2 * train_rows / max(1, docs.count()))
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    hashed = texts.withColumn("h", F.xxhash64("text"))
    place = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    seen = staged(
        hashed.withColumn("picked", place < share).mapInArrow(
            _described, "h long, pattern string, at array<int>, values array<float>"
        ),
        "votes",
    )
    counts = {row["pattern"]: row["n"] for row in seen.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    labels = fit_labels(counts)
    # Copies hash alike; one of each is enough, taken before anything is gathered.
    picked = seen.where("at is not null").groupBy("h").agg(F.min("pattern").alias("p"), F.min("at").alias("a"), F.min("values").alias("v"))
    sample = picked.orderBy(F.shiftrightunsigned("h", 1)).limit(train_rows).collect()
    rows = [(np.array(r["a"], int), np.array(r["v"], np.float32)) for r in sample]
    return QualityModel(labels, fit_scorer(rows, labels.posterior([r["p"] for r in sample]), labels.prior))


def quality_of(model: QualityModel, text: Column) -> Column:
    """Probability that a text is good; 0 for null, empty and blank ones."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(text) for text in texts], dtype="float64")

    return score(text.cast("string"))


def score_quality(docs: DataFrame, text_col: str = "text", output: str = "quality") -> DataFrame:
    """``docs`` with the probability that each text is good.

    Equal texts, so repeated rows, get equal scores. Null, empty and blank texts get 0.
    The new column gets underscores at its end if its name is taken.
    """
    return docs.withColumn(free_name(docs, output), quality_of(fit_quality(docs, text_col), F.col(text_col)))


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the scorer doesn't reject; all columns stay."""
    model = fit_quality(docs, text_col)
    return docs.where(quality_of(model, F.col(text_col)) >= threshold)


def good_documents(docs: DataFrame) -> DataFrame:
    """doc_id, quality and keep of the documents that the scorer keeps."""
    scored = score_quality(docs.select("doc_id", "text"))
    return scored.where(F.col("quality") >= THRESHOLD).select("doc_id", "quality", F.lit(True).alias("keep"))
