"""Question understanding as column expressions: language, intent, entities.

Everything here is a narrow projection of built-in functions, so a whole table
(or stream) of questions is classified without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon

# The characters Unicode treats as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# A letter, digit or underscore. Combining marks are outside on purpose: Java's
# own word boundary disagrees with itself next to Indic vowel signs.
WORD_CHAR = r"\p{L}\p{N}_"


def strip(text: Column) -> Column:
    """Trim all Unicode white space from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def first_match(cases: Iterable[tuple[Column, Column]], default: Column) -> Column:
    """CASE over (condition, value) pairs in order."""
    result = None
    for condition, value in cases:
        result = F.when(condition, value) if result is None else result.when(condition, value)
    return default if result is None else result.otherwise(default)


# --- language -------------------------------------------------------------


def _class_of(scripts: list[tuple[str, int, int]]) -> str:
    return "".join(rf"\x{{{low:04X}}}-\x{{{high:04X}}}" for _, low, high in scripts)


def language_by_first_letter(text: Column) -> Column:
    """Language of the first letter that belongs to a known script, else ``en``.

    The scan stops at that letter; marks, digits and foreign letters are passed
    over.
    """
    letter = F.regexp_extract(
        text, rf"[\p{{Lo}}&&[{_class_of(lexicon.LETTER_SCRIPTS)}]]", 0
    )
    return first_match(
        (
            (letter.between(chr(low), chr(high)), F.lit(code))
            for code, low, high in lexicon.LETTER_SCRIPTS
        ),
        F.lit("en"),
    )


def language_by_script(text: Column) -> Column:
    """Language by script priority, then romanised-Hindi words, else ``en``.

    Any character of a script counts, marks and digits included. One scan over
    the joint range spares Latin-only text the nine single-script scans.
    """
    scripts = lexicon.PRIORITY_SCRIPTS
    by_script = first_match(
        (
            (text.rlike(f"[{_class_of([script])}]"), F.lit(script[0]))
            for script in scripts[:-1]
        ),
        F.lit(scripts[-1][0]),
    )
    romanised = F.lower(text).rlike(whole_words(lexicon.ROMANISED_HINDI))
    # Every script lies beyond the characters of one byte.
    scripted = (F.octet_length(text) > F.length(text)) & text.rlike(f"[{_class_of(scripts)}]")
    return F.when(scripted, by_script).when(romanised, F.lit("hi")).otherwise(F.lit("en"))


def whole_words(words: Iterable[str]) -> str:
    """A pattern of lower-case words a-z that stand alone; one branch per first letter."""
    branches = (
        f"{first}(?:{'|'.join(word[1:] for word in group)})"
        for first, group in groupby(sorted(words), key=lambda word: word[0])
    )
    return f"(?<![a-z])(?:{'|'.join(branches)})(?![a-z])"


def resolve_language(explicit: Column, question: Column) -> Column:
    """The stated language if there is one, else the detected one."""
    return F.coalesce(F.nullif(explicit, F.lit("")), language_by_first_letter(question))


# --- intent ---------------------------------------------------------------


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Substring test; short-circuits at the first word found."""
    return reduce(lambda a, b: a | b, (text.contains(word) for word in words))


def intent_by_keywords(
    question: Column,
    rules: Iterable[tuple[int, str, str]] = tuple(lexicon.INTENT_RULES),
    default: str = lexicon.SCHEME_ROUTE,
) -> Column:
    """Label of the lowest-priority-number rule whose keyword occurs."""
    lowered = F.lower(question)
    ordered = sorted(rules, key=lambda rule: rule[0])
    return first_match(
        (
            (contains_any(lowered, [word for _, word, _ in group]), F.lit(label))
            for (_, label), group in (
                (key, list(members))
                for key, members in groupby(ordered, key=lambda rule: (rule[0], rule[2]))
            )
        ),
        F.lit(default),
    )


def clean_label(raw: Column) -> Column:
    """A model's label without white space, double quotes, single quotes, case."""
    return F.lower(F.btrim(F.btrim(strip(raw), F.lit('"')), F.lit("'")))


def resolve_intent(raw_label: Column, question: Column, rules=tuple(lexicon.INTENT_RULES)) -> Column:
    """A recognised model label wins; otherwise keywords decide."""
    label = clean_label(raw_label)
    known = label.isin(lexicon.PRICE_ROUTE, lexicon.SCHEME_ROUTE)
    return F.when(known, label).otherwise(intent_by_keywords(question, rules))


# --- entities -------------------------------------------------------------


def word_pattern(aliases: Iterable[str]) -> str:
    """Pattern that finds any alias as a whole word."""
    quoted = "|".join(re.escape(alias) for alias in aliases)
    return f"(^|[^{WORD_CHAR}])({quoted})($|[^{WORD_CHAR}])"


def entity(
    question: Column, aliases: Iterable[tuple[str, str]], default: str | None = None
) -> Column:
    """Canonical name of the first alias, in declared order, found in the text."""
    lowered = F.lower(question)

    def found(words: list[str]) -> Column:
        # A substring test is far cheaper than the pattern, and rules most out.
        return contains_any(lowered, words) & lowered.rlike(word_pattern(words))

    return first_match(
        (
            (found([alias for alias, _ in group]), F.lit(canonical))
            for canonical, group in groupby(aliases, key=lambda pair: pair[1])
        ),
        F.lit(default).cast("string"),
    )


def commodity(question: Column, aliases=tuple(lexicon.COMMODITY_ALIASES),
              default: str | None = lexicon.DEFAULT_COMMODITY) -> Column:
    return entity(question, aliases, default)


def location(question: Column, aliases=tuple(lexicon.LOCATION_ALIASES)) -> Column:
    return entity(question, aliases)


# --- question texts -------------------------------------------------------


def question_error(question: Column) -> Column:
    """Error text for an empty question, else NULL."""
    empty = F.coalesce(strip(question), F.lit("")) == ""
    return F.when(empty, F.lit(lexicon.EMPTY_QUESTION_ERROR))


def finder_question(state: Column, crop: Column) -> Column:
    """The question a (state, crop) pick stands for; either may be missing."""

    def part(prefix: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(prefix), value)).otherwise("")

    return F.concat(
        F.lit(lexicon.FINDER_STEM), part(" growing ", crop), part(" in ", state), F.lit("?")
    )


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    """Fixed-map lookup with a default."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))
