"""Answer, badge and number texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon
from .text import lookup


def money(value: Column, missing: str = "None") -> Column:
    """``₹1,234.50``; a missing value becomes ``missing``."""
    return F.coalesce(F.concat(F.lit("₹"), F.format_number(value, 2)), F.lit(missing))


def exact_text(value: Column, places: int) -> Column:
    """Fixed-point text of the double's exact binary value, without grouping."""
    return F.replace(F.format_number(value, places), F.lit(","), F.lit(""))


def exact_round(value: Column, places: int = 2) -> Column:
    """Round the exact binary value: 2.675 is below the tie, so it gives 2.67.

    Infinite values stay as they are.
    """
    return F.coalesce(
        exact_text(value, places).try_cast("double"), F.when(F.abs(value) == float("inf"), value)
    )


def short_number(value: Column) -> Column:
    """A value already rounded to 2 places, without a trailing second zero."""
    return F.regexp_replace(exact_text(value, 2), "0$", "")


def plain_number(value: Column) -> Column:
    """Shortest digits of a double, never in exponent form below 1e16."""
    text = value.cast("string")
    plain = F.rtrim(text.cast("decimal(38,17)").cast("string"), F.lit("0"))
    return F.when(
        (F.abs(value) >= 1e7) & (F.abs(value) < 1e16),
        F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain),
    ).otherwise(text)


def by_language(language: Column, hindi: str, other: str) -> Column:
    return F.when(language == "hi", F.lit(hindi)).otherwise(F.lit(other))


def route_badge(route: Column) -> Column:
    return (
        F.when(route == lexicon.PRICE_ROUTE, F.lit(lexicon.PRICE_BADGE))
        .when(route == lexicon.ERROR_ROUTE, F.lit(lexicon.ERROR_BADGE))
        .otherwise(F.lit(lexicon.SCHEME_BADGE))
    )


def chat_badge(route: Column) -> Column:
    return F.when(route == lexicon.PRICE_ROUTE, F.lit(lexicon.CHAT_PRICE_BADGE)).otherwise(
        F.lit(lexicon.CHAT_SCHEME_BADGE)
    )


def delta_badge(percent: Column, language: Column | None = None) -> Column:
    """``▲ 5.1% over recent records``; nothing at zero or NULL."""
    suffix = by_language(
        F.lit("en") if language is None else language,
        lexicon.DELTA_SUFFIX_HI,
        lexicon.DELTA_SUFFIX,
    )
    body = F.concat(exact_text(F.abs(percent), 1), F.lit("% "), suffix)
    return F.when(percent > 0, F.concat(F.lit("▲ "), body)).when(
        percent < 0, F.concat(F.lit("▼ "), body)
    )


def explanation(commodity: Column, location: Column) -> Column:
    """One sentence on what a price answer was computed from."""
    start = F.concat(F.lit(lexicon.EXPLANATION_START), commodity)
    return F.when(
        location.isNotNull(), F.concat(start, F.lit(lexicon.EXPLANATION_PLACE), location, F.lit("'."))
    ).otherwise(F.concat(start, F.lit(lexicon.EXPLANATION_EVERYWHERE)))


def chart_title(commodity: Column, location: Column) -> Column:
    return F.concat(
        F.lit(lexicon.CHART_TITLE),
        commodity,
        F.lit(" - "),
        F.coalesce(location, F.lit(lexicon.ALL_REGIONS)),
        F.lit(")"),
    )


def price_answer_text(
    n_rows: Column,
    average: Column,
    forecast: Column,
    trend: Column,
    error: Column | None = None,
) -> Column:
    """Answer sentence of a price question.

    Only a single-row result is quoted; the forecast is left out when it is
    missing or zero.
    """
    outlook = F.when(
        F.coalesce(forecast, F.lit(0.0)) != 0.0,
        F.concat(
            F.lit(lexicon.FORECAST_TEXT),
            short_number(forecast),
            F.lit(lexicon.FORECAST_UNIT),
            F.coalesce(trend, F.lit("stable")),
            F.lit(lexicon.FORECAST_END),
        ),
    ).otherwise("")
    text = F.when(
        n_rows == 1,
        F.concat(
            F.lit(lexicon.AVERAGE_TEXT), money(average), F.lit(lexicon.AVERAGE_UNIT), outlook
        ),
    ).otherwise(F.lit(lexicon.NO_DATA_TEXT))
    if error is None:
        return text
    failed = F.coalesce(error, F.lit("")) != ""
    return F.when(
        failed, F.concat(F.lit(f"⚠️ {lexicon.QUERY_ERROR_LABEL}: "), error)
    ).otherwise(text)


def chat_answer_text(
    n_rows: Column, columns: dict[str, Column], language: Column, error: Column | None = None
) -> Column:
    """Chat form of a price answer, in Hindi or English.

    ``columns`` holds the shown name and the text of each result column; a
    column whose text is NULL does not belong to the row's result.
    """
    one_row = F.concat_ws(
        " | ",
        *(
            F.when(text.isNotNull(), F.concat(F.lit(f"**{name}**: "), text))
            for name, text in columns.items()
        ),
    )
    shown = sum((text.isNotNull().cast("int") for text in columns.values()), F.lit(0))
    count = n_rows.cast("string")
    many = F.when(
        language == "hi",
        F.concat(F.lit("**"), count, F.lit(" डेटा पॉइंट** मिले। नीचे चार्ट और डेटा देखें।")),
    ).otherwise(
        F.concat(
            F.lit("Found **"), count, F.lit(" data points**. See the chart and data below.")
        )
    )
    text = (
        F.when(F.coalesce(n_rows, F.lit(0)) == 0,
               by_language(language, lexicon.NO_DATA_TEXT_HI, lexicon.NO_DATA_TEXT))
        .when((n_rows == 1) & (shown == 1), F.lit(None).cast("string"))
        .when(n_rows == 1, one_row)
        .otherwise(many)
    )
    if error is None:
        return text
    label = by_language(language, lexicon.QUERY_ERROR_LABEL_HI, lexicon.QUERY_ERROR_LABEL)
    return F.when(
        error.isNotNull(), F.concat(F.lit("⚠️ "), label, F.lit(": "), error)
    ).otherwise(text)


def _filled(template: str, values: dict[str, Column]) -> Column:
    """Concatenate a template's literal parts with column values."""
    parts: list[Column] = []
    for piece in template.replace("{", "\0{").replace("}", "}\0").split("\0"):
        if piece.startswith("{"):
            parts.append(values[piece[1:-1]])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def prompt(question: Column, context: Column, language: Column) -> Column:
    """Model prompt, with or without document context."""
    values = {
        "question": question,
        "context": context,
        "language": lookup(language, lexicon.LANGUAGE_NAMES, lexicon.DEFAULT_LANGUAGE_NAME),
    }
    return F.when(context != "", _filled(lexicon.GROUNDED_PROMPT, values)).otherwise(
        _filled(lexicon.UNGROUNDED_PROMPT, values)
    )


def scheme_answer(model_text: Column, language: Column) -> Column:
    """The model's text if it gave one, else the busy text of the language."""
    return F.coalesce(
        F.nullif(model_text, F.lit("")),
        lookup(language, lexicon.BUSY_TEXTS, lexicon.DEFAULT_BUSY_TEXT),
    )
