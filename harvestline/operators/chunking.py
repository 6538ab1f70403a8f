"""Documents to titled paragraph chunks, as one narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE_CLASS, strip

SECTION_BREAK = r"\n-{3,}\n"
PARAGRAPH_BREAK = rf"\n{WHITESPACE_CLASS}*\n"


def slug(title: Column) -> Column:
    """Lower-case id of a title, up to its first parenthesis."""
    head = F.lower(strip(F.substring_index(title, "(", 1)))
    return F.btrim(F.regexp_replace(head, "[^a-z0-9]+", "_"), F.lit("_"))


def _filled_parts(text: Column, separator: str) -> Column:
    parts = F.transform(F.split(text, separator), strip)
    return F.filter(parts, lambda part: part != "")


def chunk_documents(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    section_break: str = SECTION_BREAK,
    paragraph_break: str = PARAGRAPH_BREAK,
    prefix_id: bool = True,
) -> DataFrame:
    """(doc_id, chunk_id, scheme, ordinal, text, embed_text) per paragraph.

    A document is sections; a section is a title line and paragraphs. Ids of
    different documents may share a slug, so they carry the document id unless
    ``prefix_id`` is off, as for a single file.
    """
    unix_lines = F.replace(
        F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")
    )
    sections = documents.select(
        F.col(doc_id).alias("doc_id"),
        F.explode(_filled_parts(strip(unix_lines), section_break)).alias("_section"),
    )
    has_body = F.instr("_section", "\n") > 0
    named = sections.withColumn("scheme", strip(F.substring_index("_section", "\n", 1)))
    # The slug is made once per section, below the explode into paragraphs.
    titled = named.select(
        "doc_id",
        "scheme",
        slug(F.col("scheme")).alias("_slug"),
        F.when(has_body, F.expr("substr(_section, instr(_section, '\n') + 1)"))
        .otherwise("")
        .alias("_body"),
    )
    paragraphs = titled.select(
        "doc_id",
        "scheme",
        "_slug",
        F.posexplode(_filled_parts(F.col("_body"), paragraph_break)).alias("ordinal", "text"),
    )
    prefix = [F.col("doc_id").cast("string")] if prefix_id else []
    return paragraphs.select(
        "doc_id",
        F.concat_ws("_", *prefix, "_slug", F.col("ordinal").cast("string")).alias(
            "chunk_id"
        ),
        "scheme",
        "ordinal",
        "text",
        F.concat_ws("\n\n", "scheme", "text").alias("embed_text"),
    )
