"""Reading, cleaning, writing and checking the price table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicon, schema
from ..session import stage
from . import versions
from .versions import Version

# Kinds of data in a version of a price table.
FACTS, CATALOGUE, ERRORS = "facts", "catalogue", "errors"
RECORD = "record"
BROKEN_LINE, BAD_DATE = "broken line", "bad date"


def read_price_text(
    spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = False
) -> DataFrame:
    """Price CSV with a header, every column as text.

    The header gives the column order unless ``columns`` does. Files whose
    header differs from it fail the job; read them with
    :func:`read_price_files`. ``multi_line`` keeps line feeds inside quotes, at
    the price of one task per file. A missing path raises before anything is
    written.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    reader = reader.option("enforceSchema", False).option("multiLine", multi_line)
    if columns is None:
        columns = reader.csv(path, inferSchema=False).columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return reader.schema(text).csv(path)


def read_price_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Price CSV as text, with what can't be parsed kept beside the rest.

    ``record`` holds the whole line where it has more or fewer cells than the
    header, and is NULL elsewhere. Reading goes on after such a line.
    """
    columns = read_price_text(spark, path, multi_line=multi_line).columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, RECORD]])
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD)
    return reader.option("enforceSchema", True).option("multiLine", multi_line).schema(text).csv(path)


def with_row_errors(raw: DataFrame, date_format: str | None = None) -> DataFrame:
    """``prices`` columns with ``error`` and, where it is set, ``record``: the row's text.

    A row is bad if its line can't be parsed or its date can't be read; every other
    row has no error. Bad numbers are NULL, as in any load.
    """
    prices = to_prices(raw, date_format, strict=False)
    date = known(F.col("date"))
    parsed = date.try_cast("date") if date_format is None else F.try_to_date(date, date_format)
    broken = F.col(RECORD).isNotNull() if RECORD in raw.columns else F.lit(False)
    error = F.when(broken, F.lit(BROKEN_LINE)).when(date.isNotNull() & parsed.isNull(), F.lit(BAD_DATE))
    cells = F.to_json(F.struct(*(c for c in raw.columns if c != RECORD)), {"ignoreNullFields": "false"})
    whole = F.coalesce(F.col(RECORD), cells) if RECORD in raw.columns else cells
    kept = raw.withColumn("_error", error).withColumn("_whole", F.when(error.isNotNull(), whole))
    return to_prices(kept, date_format, strict=False).select(
        *(c for c in prices.columns if c != RECORD), F.col("_error").alias("error"), F.col("_whole").alias(RECORD)
    )


def read_price_files(spark: SparkSession, paths: list[str], multi_line: bool = False) -> DataFrame:
    """Files or folders of price CSV, united by column name.

    Each path has one header of its own; a column that only some have is NULL in
    the others.
    """
    frames = [read_price_text(spark, path, multi_line=multi_line) for path in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def known(text: Column) -> Column:
    """NULL for the cell texts that mean missing."""
    return F.when(~text.isin(lexicon.MISSING_TOKENS), text)


def number(text: Column) -> Column:
    """Text to double; bad text and NaN become NULL.

    Java reads a type suffix or a hexadecimal float as a number; here both are
    bad text.
    """
    java_only = text.rlike(r"(?i)[0-9.][df]\s*$|0x")
    value = F.trim(text).try_cast("double")
    return F.when(~java_only, F.nullif(value, F.lit(float("nan"))))


def to_prices(raw: DataFrame, date_format: str | None = None, strict: bool = True) -> DataFrame:
    """Text columns to the ``prices`` schema.

    A bad date fails the job when ``strict``, and becomes NULL otherwise; bad
    numbers always become NULL. Columns beyond the schema are kept.
    """
    missing = [c for c in schema.PRICE_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"price columns missing: {', '.join(missing)}")
    text = known(F.col("date"))
    if date_format is None:
        date = text.cast("date") if strict else text.try_cast("date")
    else:
        date = (F.to_date if strict else F.try_to_date)(text, date_format)
    return raw.select(
        date.alias("date"),
        *(known(F.col(c)).alias(c) for c in schema.PRICE_TEXT_COLUMNS),
        *(number(F.col(c)).alias(c) for c in schema.PRICE_NUMBER_COLUMNS),
        *(known(F.col(c)).alias(c) for c in raw.columns if c not in schema.PRICE_COLUMNS),
    )


def write_prices(prices: DataFrame, path: str, errors: DataFrame | None = None) -> Version:
    """Replace the price table, one directory per commodity, and its catalogue.

    The rebalance lets AQE cut a commodity that holds most rows into several
    files and merge small ones; sorting by date inside keeps row groups narrow.
    The catalogue lists what dimension values occur together, so that terms are
    matched without the facts. ``errors`` are rows that were left out, kept in the
    same version. Readers keep the earlier version until all is written.
    """
    name, folder = versions.new_data(path)
    facts = prices.hint("rebalance", F.col("commodity")).sortWithinPartitions("commodity", "date")
    facts.write.partitionBy("commodity").parquet(f"{folder}/{FACTS}")
    spark = prices.sparkSession
    stored = spark.read.schema(prices.schema).parquet(f"{folder}/{FACTS}")
    catalogue(stored).hint("rebalance").write.parquet(f"{folder}/{CATALOGUE}")
    if errors is not None:
        errors.write.parquet(f"{folder}/{ERRORS}")
    return versions.publish(spark, path, {versions.WHOLE: name})


def catalogue(prices: DataFrame) -> DataFrame:
    """The (commodity, market, state) that occur. Each task sends every triple once."""
    return prices.select(*schema.PRICE_TEXT_COLUMNS).distinct()


def open_prices(
    spark: SparkSession, path: str, columns: T.StructType = schema.PRICES, version: Version | None = None
) -> DataFrame:
    """The stored table; the declared columns keep partition values as text.

    ``version`` pins what is read; without it that is the newest now.
    """
    pinned = version or versions.pinned(spark, path)
    return spark.read.schema(columns).parquet(*pinned.folders(FACTS)).select(*columns.names)


def open_catalogue(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """The stored catalogue of a price table."""
    pinned = version or versions.pinned(spark, path)
    columns = ", ".join(f"{c} string" for c in schema.PRICE_TEXT_COLUMNS)
    return spark.read.schema(columns).parquet(*pinned.folders(CATALOGUE))


def load_prices(spark: SparkSession, csv_path: str, table_path: str, **options) -> DataFrame:
    """CSV to price table, further columns included; returns the stored table."""
    prices = to_prices(read_price_text(spark, csv_path), **options)
    version = write_prices(prices, table_path)
    return open_prices(spark, table_path, prices.schema, version)


def load_checked(spark: SparkSession, csv_path: str, table_path: str, date_format: str | None = None) -> Version:
    """CSV to price table without the rows that can't be read; these are kept with their error."""
    rows = stage(with_row_errors(read_price_records(spark, csv_path), date_format), "checked")
    good = rows.where(F.col("error").isNull()).drop("error", RECORD)
    return write_prices(good, table_path, rows.where(F.col("error").isNotNull()).select("error", RECORD))


def open_errors(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """(error, record) of the rows that a checked load left out."""
    pinned = version or versions.pinned(spark, path)
    return spark.read.schema(f"error string, {RECORD} string").parquet(*pinned.folders(ERRORS))


def row_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("n_rows"))


def column_report(table: DataFrame) -> DataFrame:
    """Name and type of each column, with the rows and values found in it."""
    fields = table.schema.fields
    counts = table.agg(
        F.count("*").alias("_rows"), *(F.count(F.col(f.name)).alias(f.name) for f in fields)
    )
    entries = F.array(
        *(
            F.struct(
                F.lit(i).cast("bigint").alias("ord"),
                F.lit(f.name).alias("name"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col("_rows").alias("n_rows"),
                F.col(f.name).alias("n_values"),
            )
            for i, f in enumerate(fields)
        )
    )
    return counts.select(F.inline(entries))


def sample(table: DataFrame, n: int = lexicon.SAMPLE_ROWS) -> DataFrame:
    """The first ``n`` rows in a total order, so that the result is stable."""
    return table.orderBy(*table.columns).limit(n)
