"""Secrets in documents: candidates by pattern, false positives removed by a random forest.

A candidate is a long run of key characters, or any value of ``SHORTEST`` or more printable
signs that something with a secret's name is set to. The forest sees its length, how characters
of different classes follow each other, how much of it common words cover, the path it
stands in and the words around it. It is trained from labelled findings: a table of a
caller, or findings of the documents that are sure by their form or what is assigned to
what. Texts are read once and not shuffled; only candidates are kept, and Spark's own
forest is fitted on a bounded sample of them and applied to all.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, staged

by_value(__name__)

# Labelled findings that the forest is trained on at most; those of the smallest hashes.
TRAIN_FINDINGS = 10_000
TREES = 20
DEPTH = 6
THRESHOLD = 0.5
LEAST = 12
# The same of a value that a secret's name is set to.
SHORTEST = 4

_RUN = re.compile(r"[A-Za-z0-9+/_\-]{%d,}={0,2}" % LEAST)
_ASSIGNED = re.compile(r"([A-Za-z_\-]{2,40})[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}[\"']?$")
# What is set to a secret's name: up to its quote, or up to a blank, a quote or the next setting.
_SET = re.compile(
    r"(?:password|passwd|pwd|secret|token|api[_\-]?key|access_key|private_key|credential|auth(?!or(?!iz)))[A-Za-z_\-]{0,38}"
    r"[\"']?\s{0,3}(?:=>|:=|=|:)(?![=>])[^\S\n]{0,3}(?:\"([^\"\n]+)\"|'([^'\n]+)'|[\"']?((?:(?![&;,][A-Za-z_][\w.\-]*[=:])[^\s\"'])+))",
    re.IGNORECASE,
)
_DIGIT = re.compile(r"[0-9]")
_WORDS = re.compile(r"[^\W\d_]+")
_CLASS = {c: k for k, cs in enumerate(("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/=", "_-")) for c in cs}
_CLASSES = np.array([_CLASS.get(chr(c), 5) for c in range(129)])
_PLACEHOLDER = re.compile(r"^[$<%{\[]|\(|\*{3}|\.\.\.")
# How keys of well-known providers begin, and what secrets are called.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "npm_", "pypi-")
NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "private_key", "auth", "credential")
# Words that stand in examples and identifiers rather than in keys.
COMMON = (
    "example", "sample", "test", "dummy", "fake", "your", "change", "placeholder", "default", "key", "token", "password", "secret",
    "user", "name", "value", "data", "file", "path", "http", "www", "com", "org", "index", "page", "image", "the", "and", "for", "with",
    "tion", "ing", "ment", "keit", "schaft", "lich",
)
FEATURES = (
    "length", "digits", "upper", "lower", "transitions", "distinct", "entropy", "longest_run", "hexadecimal", "covered",
    "repeats", "assigned", "named", "quoted", "in_path", "test_path", "sentence",
)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters with a digit, and whatever something with a secret's name is set to.

    A run that such a value begins with is part of it, others inside stay of their own.
    """
    values = {}
    for m in _SET.finditer(text):
        start, end = m.span(m.lastindex)
        if m.lastindex == 3:  # signs that end a sentence or a bracket around the setting
            end = start + len(m.group(3).rstrip(",;.)]}>"))
        if end - start >= SHORTEST:
            values[start] = end
    found = set(values.items())
    for m in _RUN.finditer(text):
        start, end = m.span()
        if values.get(start, 0) < end and (_DIGIT.search(text, start, end) or _name_before(text, start)):
            found.add((start, end))
    return sorted(found)


def _name_before(text: str, start: int) -> str:
    m = _ASSIGNED.search(text[max(0, start - 50) : start])
    return m.group(1).lower() if m else ""


def describe(text: str, start: int, end: int, path: str | None) -> tuple[list[float], float | None]:
    """(features, label): 1 and 0 for findings that are sure by themselves, else None."""
    run = text[start:end]
    n = len(run)
    codes = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), "<u4")
    classes = _CLASSES[np.minimum(codes, 128)]
    counts = Counter(run)
    share = [np.count_nonzero(classes == k) / n for k in range(3)]
    edges = np.flatnonzero(classes[1:] != classes[:-1]) + 1
    changes = len(edges) / n
    longest = int(np.diff(edges, prepend=0, append=n).max())
    low = run.lower()
    covered = sum(len(w) * low.count(w) for w in COMMON) / n
    name = _name_before(text, start)
    named = any(word in name for word in NAMES)
    around = _WORDS.findall(text[max(0, start - 60) : start])[-3:]
    near = any(word.lower() in NAMES for word in around)
    before, after = text[start - 1 : start], text[end : end + 1]
    place = (path or "").lower()
    features = [
        min(n, 200.0),
        *share,
        changes,
        len(counts) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        longest / n,
        float(all(c in "0123456789abcdef" for c in low)),
        min(covered, 1.0),
        np.count_nonzero(codes[1:] == codes[:-1]) / n,
        float(bool(name)),
        float(named or near),
        float(before in "\"'`" and before != ""),
        float(before in "/.\\" and before != "" or after in "/." and after != "" or "/" in run[:3]),
        float(any(word in place for word in ("test", "example", "sample", "doc", "fixture"))),
        float(before == " " and after in " ,.;"),
    ]
    varied = len(counts) >= 6 and covered < 0.5
    if not _RUN.fullmatch(run) and not run.startswith(PREFIXES):
        # Other signs or short: sure are mixed values with digits, and plain words and placeholders.
        if named and varied and 0 < share[0] < 1 and not _PLACEHOLDER.search(run):
            return features, 1.0
        return features, 0.0 if run.isalpha() or covered >= 0.5 or _PLACEHOLDER.search(run) else None
    if varied and (run.startswith(PREFIXES) or named):
        return features, 1.0
    if not name and not near and (covered >= 0.5 or share[0] == 1.0 or len(counts) < 6):
        return features, 0.0
    return features, None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc", "start", "end", "features", "label"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64()]
    for batch in batches:
        rows = []
        for doc, value, path in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            text = value.as_py() or ""
            for start, end in candidates(text):
                rows.append((doc, start, end, *describe(text, start, end, path)))
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def fixed_findings() -> list[tuple[str, int, int, str | None, float]]:
    """(text, start, end, path, label) of made-up keys and of runs that are none.

    They are part of every training set, so that it has both classes and findings that
    are not sure by themselves get a score whatever else the documents hold.
    """
    found = []
    for i in range(24):
        digest = hashlib.sha256(f"finding {i}".encode()).digest()
        key = base64.urlsafe_b64encode(digest).decode()[: 20 + i % 24]
        name = NAMES[i % len(NAMES)]
        around = (f'{name} = "', '"') if i % 2 else (f"{name}: ", "")
        words = "-".join(COMMON[(i + k) % len(COMMON)] for k in range(3))
        for before, run, after, label in (
            (*around[:1], key, *around[1:], 1.0),
            ("see ", f"{words}-{i:03d}", " there", 0.0),
            ("order ", str(int.from_bytes(digest[:6], "big")).zfill(LEAST + 2), " was sent.", 0.0),
        ):
            found.append((before + run + after, len(before), len(before) + len(run), None, label))
    return found


def _trained(labelled: DataFrame, train_findings: int):
    """A forest on a bounded sample of each class and the fixed findings."""
    known = labelled.where("label is not null").select("features", "label").distinct()
    place = F.xxhash64("features")
    parts = [known.where(F.col("label") == y).orderBy(place, "features").limit(train_findings // 2) for y in (0.0, 1.0)]
    fixed = [([float(x) for x in describe(*finding[:4])[0]], finding[4]) for finding in fixed_findings()]
    fixed = labelled.sparkSession.createDataFrame(fixed, "features array<double>, label double")
    sample = staged(parts[0].unionByName(parts[1]).unionByName(fixed), "findings")
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7, minInstancesPerNode=2, subsamplingRate=0.8
    )
    return forest.fit(sample.withColumn("vector", array_to_vector("features")))


def scan_secrets(
    docs: DataFrame,
    findings: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str | None = "source",
    train_findings: int = TRAIN_FINDINGS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id_col, start, end, probability) of the candidates that the forest takes for secrets.

    ``findings`` (text, start, end, path, label 0 or 1) are labelled findings; without them
    those of ``docs`` that are sure by themselves teach. Offsets are code points, end
    exclusive. Null and empty texts have no candidates. Rows that repeat a document
    repeat its findings. ``fixed_findings`` complete the training set, so every candidate
    gets a score, with findings of one class only or none too. Other columns are not read.
    """
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"), path.alias("path"))
    found = staged(rows.mapInArrow(_scan, "doc long, start long, end long, features array<double>, label double"), "candidates")
    model = _trained(found if findings is None else described_findings(findings), train_findings)
    judged = model.transform(found.withColumn("vector", array_to_vector("features")))
    scored = judged.withColumn("probability", F.get(vector_to_array("probability"), 1)).where(F.col("probability") >= threshold)
    return scored.select(F.col("doc").alias(id_col), "start", "end", "probability")


def described_findings(findings: DataFrame) -> DataFrame:
    """(features, label) of labelled findings (text, start, end, path, label)."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for row in batch.to_pylist() if None not in (row["text"], row["start"], row["end"], row["label"])]
            features = [describe(r["text"], r["start"], r["end"], r["path"])[0] for r in rows if r["end"] > r["start"]]
            labels = [float(r["label"]) for r in rows if r["end"] > r["start"]]
            yield pa.RecordBatch.from_arrays([pa.array(features, pa.list_(pa.float64())), pa.array(labels, pa.float64())], ["features", "label"])

    picked = findings.select("text", "start", "end", "path", "label")
    return picked.mapInArrow(described, "features array<double>, label double")


def document_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, probability and secret (true) of all secrets of ``docs``."""
    return scan_secrets(docs).withColumn("secret", F.lit(True))
