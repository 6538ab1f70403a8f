"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns find e-mail addresses, IP addresses, payment cards and phone numbers as
they are usually written; those spans always stay. The field adds those that are
written otherwise ("name (at) host dot org", numbers with other separators). It scores
whole candidate segments: digit groups, separators, checksums, and the words around
them. A bounded dynamic programme over the tokens of a window chooses boundaries and
kinds of all its entities at once.

The field is trained here, on windows of the documents: windows with pattern spans,
the same spans rewritten by rule in unusual forms, and windows whose numbers are none
of these. The sample is bounded; detection is one pass over all whole texts.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, free_name

by_value(__name__)

KINDS = ("email", "ip", "card", "phone")
# Windows of each sort (with and without pattern spans) that the field is trained on at most.
TRAIN_WINDOWS = 300
EPOCHS = 8
RATE = 0.4
RIDGE = 1e-3
DIMENSIONS = 1 << 13
# An added entity has at most so many tokens and characters.
MAX_TOKENS = 16
MAX_CHARS = 80
# Characters of context on both sides of an anchor.
CONTEXT = 40
# By so much an entity's segment must outweigh that its tokens are none.
MARGIN = 2.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number starts where no digit is before it, so long runs of digits are read once.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_ANY = re.compile(r"[0-9@]")
# What an entity has at least: digits side by side, single ones near each other, or a sign or word for at and dot.
_ANCHOR = re.compile(r"\d{2,}|(?<![^\W_])(?P<one>\d)(?![^\W_])|@|(?<![^\W_])(?:at|dot)(?![^\W_])", re.IGNORECASE)
# So many digits make an entity of several tokens.
LEAST_DIGITS = 4
_TOKEN = re.compile(r"[^\W_]+|[^\s]")

Span = tuple[int, int, str]


# --- patterns ----------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        total += value if place % 2 == 0 else 2 * value - 9 * (value > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (part or "0").isdecimal() and int(part or 0) <= 255


def pattern_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and without overlap within a kind, in order."""
    if not _ANY.search(text):
        return []
    found: list[Span] = [(a, b, "email") for a, b in _emails(text)]
    found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(_part_fits, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m.group())) <= 15:
            found.append((*m.span(), "phone"))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# --- segments and their features ---------------------------------------------


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches of text around anchors, merged where they meet, cut at white space."""
    found: list[list[int]] = []
    ones: deque[int] = deque(maxlen=LEAST_DIGITS)
    for m in _ANCHOR.finditer(text):
        first = m.start()
        if m["one"]:  # single digits are an anchor if enough of them fit in an entity
            ones.append(first)
            first = ones[0]
            if len(ones) < LEAST_DIGITS or m.end() - first > MAX_CHARS:
                continue
        start, end = max(0, first - CONTEXT), min(len(text), m.end() + CONTEXT)
        while found and start <= found[-1][1]:
            start = min(start, found.pop()[0])
        found.append([start, end])
    return [(a, b) for a, b in found]


def _spelled(tokens: list[str]) -> tuple[bool, bool]:
    low = [t.lower() for t in tokens]
    return "@" in low or "at" in low[1:-1], "." in low or "dot" in low[1:-1]


def _form(tokens: list[str]) -> str:
    """How words, at and dot follow each other, whatever brackets are around them."""
    marks = {"@": "@", "at": "@", ".": ".", "dot": "."}
    return "".join(marks.get(t.lower(), "w" if t.isalnum() else "") for t in tokens)


def _features(text: str, at: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of the whole span of tokens ``i`` to ``j``, both included."""
    start, end = at[i][0], at[j][1]
    span = text[start:end]
    tokens = [text[a:b] for a, b in at[i : j + 1]]
    groups = [t for t in tokens if t.isdigit()]
    digits = "".join(groups)
    signs = "".join(sorted({t for t in tokens if not t.isalnum()}))
    gaps = "".join(sorted({text[at[k][1] : at[k + 1][0]][:1] for k in range(i, j)}))
    letters = sum(t.isalpha() for t in tokens)
    has_at, has_dot = _spelled(tokens)
    sizes = "-".join(str(len(g)) for g in groups[:6])
    before = text[at[i - 1][0] : at[i - 1][1]].lower() if i else "^"
    after = text[at[j + 1][0] : at[j + 1][1]].lower() if j + 1 < len(at) else "$"
    mixed = any(not t.isalpha() and not t.isdigit() and t.isalnum() for t in tokens)
    return [
        f"digits {len(digits)} {letters > 0}",
        f"groups {sizes} {letters > 0}",
        f"signs {signs}",
        f"gaps {gaps} {signs}",
        f"letters {min(letters, 6)} at {has_at} dot {has_dot}",
        f"checksum {12 <= len(digits) <= 19 and luhn(digits)} {letters > 0}",
        f"bytes {len(groups) == 4 and all(map(_part_fits, groups))} {letters > 0}",
        f"first {tokens[0] if not tokens[0].isalnum() else 'word' if tokens[0].isalpha() else 'number'}",
        f"last {tokens[-1] if not tokens[-1].isalnum() else 'word' if tokens[-1].isalpha() else 'number'} {len(tokens[-1]) if tokens[-1].isalpha() and has_at else ''}",
        f"mixed {mixed} {has_at}",
        f"tokens {j - i} {has_at}",
        f"form {_form(tokens) if has_at else ''}",
        f"size {len(span) // 8}",
        f"before {before if not before.isalnum() else 'word' if before.isalpha() else 'number'}",
        f"after {after if not after.isalnum() else 'word' if after.isalpha() else 'number'}",
        "bias",
    ]


def _slots(features: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(f.encode()) % DIMENSIONS for f in features])


def _able(tokens: list[str]) -> bool:
    """Whether a run of tokens may be an entity at all."""
    if not (tokens[0].isalnum() or tokens[0] in "+(") or not tokens[-1].isalnum():
        return False
    digits = sum(len(t) for t in tokens if t.isdigit())
    if LEAST_DIGITS <= digits <= 20 and len(tokens) > 1 or digits >= 9:
        return True
    has_at, has_dot = _spelled(tokens)
    return has_at and has_dot and len(tokens) > 4


def _none_able(tokens: list[str]) -> bool:
    """Whether it is plain that no run of these tokens may be an entity."""
    if sum(len(t) for t in tokens if t.isdigit()) >= LEAST_DIGITS:
        return False
    low = {t.lower() for t in tokens}
    return not (low & {"@", "at"} and low & {".", "dot"})


def segments(text: str, start: int, end: int, taken: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(token offsets, candidate (i, j)) of a window; none overlaps a taken stretch. Those are sorted."""
    at = [m.span() for m in _TOKEN.finditer(text, start, end)]
    if at and start > 0 and not text[start - 1].isspace() and text[at[0][0]].isalnum() and at[0][0] == start and text[start - 1].isalnum():
        at = at[1:]  # the window cuts this token
    if at and end < len(text) and at[-1][1] == end and text[end - 1].isalnum() and text[end].isalnum():
        at = at[:-1]
    words = [text[a:b] for a, b in at]
    free, number, reach = [], 0, start
    for a, b in at:  # both are in order; ``reach`` is how far the spans that start before b go
        while number < len(taken) and taken[number][0] < b:
            reach = max(reach, taken[number][1])
            number += 1
        free.append(reach <= a)
    found = []
    for i in range(len(at)):
        if not (words[i].isalnum() or words[i] in "+(") or _none_able(words[i : i + MAX_TOKENS]):
            continue
        for j in range(i, min(len(at), i + MAX_TOKENS)):
            if not free[j] or at[j][1] - at[i][0] > MAX_CHARS:
                break
            if _able(words[i : j + 1]):
                found.append((i, j))
    return at, found


# --- the field ---------------------------------------------------------------


def best_segments(n: int, found: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int, int]]:
    """(i, j, kind) of the best segmentation of ``n`` tokens; other tokens score 0."""
    best, back = np.zeros(n + 1), [None] * (n + 1)
    ending: dict[int, list[int]] = {}
    for number, (_, j) in enumerate(found):
        ending.setdefault(j + 1, []).append(number)
    for end in range(1, n + 1):
        best[end] = best[end - 1]
        for number in ending.get(end, ()):
            kind = int(np.argmax(scores[number]))
            total = best[found[number][0]] + scores[number, kind]
            if total > best[end]:
                best[end], back[end] = total, (number, kind)
    out, end = [], n
    while end > 0:
        if back[end] is None:
            end -= 1
        else:
            number, kind = back[end]
            out.append((*found[number], kind))
            end = found[number][0]
    return out[::-1]


def marginals(n: int, found: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    """Probability of each candidate segment and kind under all segmentations."""
    ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
    ending: dict[int, list[int]] = {}
    opening: dict[int, list[int]] = {}
    summed = np.logaddexp.reduce(scores, axis=1) if len(found) else np.zeros(0)
    for number, (i, j) in enumerate(found):
        ending.setdefault(j + 1, []).append(number)
        opening.setdefault(i, []).append(number)
    for end in range(1, n + 1):
        ahead[end] = ahead[end - 1]
        for number in ending.get(end, ()):
            ahead[end] = np.logaddexp(ahead[end], ahead[found[number][0]] + summed[number])
    for start in range(n - 1, -1, -1):
        behind[start] = behind[start + 1]
        for number in opening.get(start, ()):
            behind[start] = np.logaddexp(behind[start], behind[found[number][1] + 1] + summed[number])
    out = np.array([ahead[i] + behind[j + 1] for i, j in found])[:, None] + scores - ahead[n]
    return np.exp(np.minimum(out, 0))


def fit_field(samples: list[tuple[str, list[Span]]]) -> np.ndarray:
    """Weights (slot, kind) from windows with their entities, by adaptive gradient steps."""
    weights, squares = np.zeros((DIMENSIONS, len(KINDS))), np.ones((DIMENSIONS, len(KINDS)))
    rows = []
    for text, spans in samples:
        at, found = segments(text, 0, len(text), [])
        if not found:
            continue
        slots = np.stack([_slots(_features(text, at, i, j)) for i, j in found])
        gold = np.zeros((len(found), len(KINDS)))
        where = {(at[i][0], at[j][1]): number for number, (i, j) in enumerate(found)}
        for start, end, kind in spans:
            if (start, end) in where:
                gold[where[start, end], KINDS.index(kind)] = 1
        rows.append((len(at), found, slots, gold))
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for number in order.permutation(len(rows)):
            n, found, slots, gold = rows[number]
            off = gold - marginals(n, found, weights[slots].sum(axis=1))
            moved = np.flatnonzero(np.abs(off).sum(axis=1) > 1e-4)
            if not len(moved):
                continue
            flat = slots[moved].ravel()
            each = np.repeat(off[moved], slots.shape[1], axis=0)
            slope = np.zeros((0, len(KINDS)))
            unique, inverse = np.unique(flat, return_inverse=True)
            slope = np.zeros((len(unique), len(KINDS)))
            np.add.at(slope, inverse, each)
            slope -= RIDGE * weights[unique]
            squares[unique] += slope * slope
            weights[unique] += RATE * slope / np.sqrt(squares[unique])
    return weights


def added_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """Entities that the field finds beside the pattern spans."""
    found: list[Span] = []
    taken = [(a, b) for a, b, _ in base]
    starts = [a for a, _ in taken]
    place = 0
    for start, end in windows(text):
        while place < len(taken) and taken[place][1] < start - 200:
            place += 1
        near = [t for t in taken[place : bisect_left(starts, end)] if t[1] > start]
        at, able = segments(text, start, end, near)
        if not able:
            continue
        slots = np.stack([_slots(_features(text, at, i, j)) for i, j in able])
        scores = weights[slots].sum(axis=1) - MARGIN
        found += [(at[i][0], at[j][1], KINDS[kind]) for i, j, kind in best_segments(len(at), able, scores)]
    return found


# --- training windows --------------------------------------------------------


def rewritten(text: str, spans: list[Span], turn: int) -> tuple[str, list[Span]]:
    """A window with its pattern spans written in another form, picked by ``turn``."""
    out, at, moved = "", 0, []
    for number, (start, end, kind) in enumerate(spans):
        if start < at:
            continue
        out += text[at:start]
        new = _other_form(text[start:end], kind, turn + number)
        moved.append((len(out), len(out) + len(new), kind))
        out += new
        at = end
    return out + text[at:], moved


def _other_form(span: str, kind: str, turn: int) -> str:
    digits = "".join(_DIGITS.findall(span))
    if kind == "email":
        at = (" at ", " (at) ", "(at)", " [at] ", "@")[turn % 5]
        dot = (" dot ", ".", " (dot) ", " [dot] ")[turn // 2 % 4]
        dot = " dot " if at == "@" else dot
        name, _, host = span.partition("@")
        words = [w for w in re.split(r"[^A-Za-z]+", name) if w] or ["box"]
        name = (name, words[0], ".".join(words), f"{words[0]}{turn % 90 + 10}", "_".join(words))[turn // 3 % 5]
        labels = host.split(".")
        if turn // 5 % 2 and len(labels) > 2:
            labels = labels[1:]
        if turn // 7 % 2:
            labels[-1] = ("org", "net", "de", "fr", "es", "edu", "io", "co")[turn // 11 % 8]
        return name.replace(".", dot if turn % 2 else ".") + at + dot.join(labels)
    if kind == "ip":
        return span.replace(".", (" . ", "[.]", "(.)", " dot ")[turn % 4])
    if kind == "card":
        sign = (".", "/", "_", " - ")[turn % 4]
        return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    national = digits[-10:]
    a, b, c = national[:3], national[3:6], national[6:]
    return (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"00{digits[:-10] or '1'} {a} {b} {c}", f"{a} {b} {c}")[turn % 6]


def decoy(text: str, spans: list[Span], turn: int) -> str:
    """A window with its pattern spans replaced by numbers and words that are none."""
    out, at = "", 0
    for number, (start, end, _) in enumerate(spans):
        if start < at:
            continue
        n = turn + 3 * number
        a, b, c = n * 7919 % 9000 + 1000, n * 104729 % 90 + 10, n * 1299709 % 28 + 1
        broken = next(d for d in range(10) if not luhn(f"{a}{b}{c:02}{a}{b}{c:02}{d}"))
        out += text[at:start] + (
            f"19{b}-{n % 12 + 1:02}-{c:02}",
            f"{c}.{n % 12 + 1:02}.20{b}",
            f"{n % 12 + 1}/{c}/20{b}",
            f"{a}{b}{c:02}{a}{b}{c:02}{broken}",
            f"{n % 24:02}:{b % 60:02}:{c:02}",
            f"19{b}-20{b}",
            f"{b},{a % 1000:03},{b}{c % 10}.{c:02}",
            f"{c}.{b}.{n % 10}",
            f"{a} {b}{c}",
            f"{a:x}{b:x}{a * b:x}{c:x}{a * a:x}",
            f"{a}-{a + b}",
            "meet at noon dot",
            f"looked at {b} of {a}",
            f"{a}.{b}{c:02}",
            f"{a}{b}{c:02}{a}",
            f"{a % 900 + 100}.{b}.{a}.{c}",
        )[n % 16]
        at = end
    return out + text[at:]


def _cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, marks = [], []
        for value in batch.column(0):
            text = value.as_py() or ""
            base = pattern_spans(text)
            for start, end in windows(text):
                inside = [(a - start, b - start, k) for a, b, k in base if a >= start and b <= end]
                if end - start <= 600 and not any(a < start < b or a < end < b for a, b, _ in base):
                    texts.append(text[start:end])
                    marks.append([f"{a}:{b}:{k}" for a, b, k in inside])
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(marks, pa.list_(pa.string()))], ["text", "marks"])


def train(docs: DataFrame, text_col: str = "text", train_windows: int = TRAIN_WINDOWS) -> np.ndarray:
    """Weights of the field from windows of a part of the texts, each distinct window once.

    The part and the windows are those of the smallest hashes. Without windows all
    weights are zero, and the field adds nothing.
    """
    share = min(1.0, 20 * train_windows / max(1, docs.count()))
    text = F.col(text_col).cast("string")
    place = F.shiftrightunsigned(F.xxhash64(text), 11) / F.lit(float(1 << 53))
    part = docs.where(place < share).select(text.alias("text"))
    cut = part.mapInArrow(_cut_windows, "text string, marks array<string>").distinct()
    cut = cut.withColumn("h", F.xxhash64("text")).withColumn("sort", F.size("marks") > 0)
    rows = []
    for sort in (True, False):
        rows += cut.where(F.col("sort") == sort).orderBy("h", "text").limit(train_windows).collect()
    samples: list[tuple[str, list[Span]]] = []
    for turn, row in enumerate(rows):
        spans = [(int(a), int(b), k) for a, b, k in (mark.split(":") for mark in row["marks"])]
        samples.append((row["text"], spans))
        if spans:
            samples += [rewritten(row["text"], spans, 7 * turn + more) for more in range(3)]
            samples += [(decoy(row["text"], spans, 5 * turn + more), []) for more in range(2)]
    return fit_field(samples)


# --- detection ---------------------------------------------------------------

FOUND = T.StructType(
    [T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS]
    + [T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]
)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_personal_data(docs: DataFrame, weights: np.ndarray, text_col: str = "text", output: str = "found") -> DataFrame:
    """``docs`` with a struct ``output``: counts of pattern spans by kind, base, spans, n_added.

    ``base`` and ``spans`` list kind:start:end by start, then kind, comma-joined, in code
    points, end exclusive; ``spans`` also has what the field adds, which never overlaps
    a pattern span. A null text is an empty one: no spans. Equal texts get equal spans.
    The new column gets underscores at its end if its name is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            text = text or ""
            base = pattern_spans(text)
            added = added_spans(text, base, shared.value)
            kinds = [kind for _, _, kind in base]
            rows.append((*[kinds.count(kind) for kind in KINDS], _joined(base), _joined(in_order(base + added)), len(added)))
        return pd.DataFrame(rows, columns=FOUND.names)

    return docs.withColumn(free_name(docs, output), find(F.col(text_col).cast("string")))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added of every row."""
    picked = docs.select("doc_id", "text")
    found = F.col("found")
    return find_personal_data(picked, train(picked)).select(
        "doc_id",
        *[found[f"n_{kind}"].alias(f"n_{kind}") for kind in KINDS],
        F.sha2(found["base"], 256).alias("base_sha256"),
        found["spans"].alias("spans"),
        found["n_added"].alias("n_added"),
    )


def sha256_of(spans: list[Span]) -> str:
    return hashlib.sha256(_joined(spans).encode()).hexdigest()
