"""The test tables in the shape the library works on, in Spark and in SQL.

Every view reads its tables whole. The SQL constants are common table
expressions that DuckDB can run over views of the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestline.plans.answers import Vocabulary
from harvestline.session import MAX_BROADCAST_BYTES, is_small, stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- prices ---------------------------------------------------------------


def prices_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit prices of line items: part type, supplier, nation, ship date."""
    price = (F.col("l_extendedprice") / F.col("l_quantity")).alias("modal_price")
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", price)
    part = table(spark, sf_dir, "part")
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    return (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("p_type").alias("commodity"),
            F.col("s_name").alias("market"),
            F.col("n_name").alias("state"),
            "modal_price",
        )
    )


def goods_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commodities of the star prices, from their dimension table."""
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("commodity")).distinct()


def places_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets and states of the star prices, from their dimension tables."""
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    placed = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return placed.select(F.col("s_name").alias("market"), F.col("n_name").alias("state"))


STAR = """
prices AS (
  SELECT CAST(l_shipdate AS date) AS date, p_type AS commodity, s_name AS market,
         n_name AS state, l_extendedprice / l_quantity AS modal_price
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
)"""


def prices_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as short series: one month, five event types."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("date").alias("date"),
        F.col("event_type").alias("commodity"),
        F.concat(F.lit("market_"), (F.col("user_id") % 10).cast("string")).alias("market"),
        F.concat(F.lit("state_"), (F.col("user_id") % 5).cast("string")).alias("state"),
        F.col("value").alias("modal_price"),
    )


EVENTS = """
prices AS (
  SELECT CAST(ts AS date) AS date, event_type AS commodity,
         'market_' || CAST(user_id % 10 AS varchar) AS market,
         'state_' || CAST(user_id % 5 AS varchar) AS state, value AS modal_price
  FROM events
)"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a text table, as a price file would come: some cells bad."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("record"),
        F.col("ts").cast("date").cast("string").alias("date"),
        kind.alias("commodity"),
        F.concat(F.lit("market_"), (F.col("user_id") % 10).cast("string")).alias("market"),
        F.when(kind == "signup", F.lit("N/A"))
        .otherwise(F.concat(F.lit("state_"), (F.col("user_id") % 5).cast("string")))
        .alias("state"),
        F.when(kind == "error", F.lit("NA"))
        .when(kind == "click", F.lit("nan"))
        .when(kind == "view", F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
        .otherwise(F.col("props"))
        .alias("min_price"),
        F.regexp_extract("props", "[0-9]+", 0).alias("max_price"),
        F.col("value").cast("string").alias("modal_price"),
    )


RAW = """
raw AS (
  SELECT CAST(event_id AS varchar) AS record, CAST(CAST(ts AS date) AS varchar) AS date,
         event_type AS commodity, 'market_' || CAST(user_id % 10 AS varchar) AS market,
         CASE WHEN event_type = 'signup' THEN 'N/A'
              ELSE 'state_' || CAST(user_id % 5 AS varchar) END AS state,
         CASE event_type WHEN 'error' THEN 'NA' WHEN 'click' THEN 'nan'
              WHEN 'view' THEN ' ' || CAST(value AS varchar) || ' ' ELSE props END AS min_price,
         regexp_extract(props, '[0-9]+') AS max_price, CAST(value AS varchar) AS modal_price
  FROM events
),
loaded AS (
  SELECT CAST(date AS date) AS date, commodity, market, nullif(state, 'N/A') AS state,
         CASE WHEN isnan(TRY_CAST(min_price AS double)) THEN NULL
              ELSE TRY_CAST(min_price AS double) END AS min_price,
         TRY_CAST(max_price AS double) AS max_price,
         TRY_CAST(modal_price AS double) AS modal_price, record
  FROM raw
)"""


def asked_star(prices: DataFrame, region: DataFrame, nation: DataFrame) -> DataFrame:
    """Pairs to ask of the star prices: each part type everywhere, in each
    nation it is sold from, and in that nation's region, which no market or
    state is named after."""
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    sold = prices.select("commodity", "state").distinct()
    joined = sold.join(places, sold["state"] == places["n_name"])
    locations = F.array(F.lit(None).cast("string"), F.col("n_name"), F.col("r_name"))
    return joined.select(
        F.col("commodity").alias("term"), F.explode(locations).alias("loc")
    ).distinct()


ASKED = """
asked AS (
  SELECT DISTINCT commodity AS term, unnest([NULL, n_name, r_name]) AS loc
  FROM prices JOIN nation ON state = n_name JOIN region ON n_regionkey = r_regionkey
),
dims AS (SELECT DISTINCT commodity, market, state FROM prices),
members AS (
  SELECT term, loc, commodity, market, state FROM asked JOIN dims
    ON commodity ILIKE '%' || term || '%'
   AND (market ILIKE '%' || loc || '%' OR state ILIKE '%' || loc || '%')
),
scopes AS (
  SELECT a.term, a.loc, CASE WHEN m.term IS NULL THEN 'all' ELSE 'located' END AS stats_scope
  FROM asked a LEFT JOIN (SELECT DISTINCT term, loc FROM members) m
    ON a.term = m.term AND a.loc = m.loc
),
facts AS (
  SELECT s.term, s.loc, s.stats_scope, p.commodity, p.market, p.state, p.date, p.modal_price
  FROM scopes s JOIN prices p ON p.commodity ILIKE '%' || s.term || '%'
   AND (s.stats_scope = 'all' OR p.market ILIKE '%' || s.loc || '%'
        OR p.state ILIKE '%' || s.loc || '%')
),
series AS (
  SELECT term, loc, stats_scope, date, avg(modal_price) AS modal_price
  FROM facts GROUP BY ALL
)"""


def fit_sql(keys: str, source: str = "series") -> str:
    """Statistics of each series, as common table expressions ending in ``stats``."""
    return f"""
indexed AS (
  SELECT *, date_diff('day', min(date) OVER (PARTITION BY {keys}), date) AS day_index
  FROM {source}
),
fitted AS (
  SELECT {keys}, count(*) AS n, arg_max_null(modal_price, date) AS latest_price,
         arg_min_null(modal_price, date) AS earliest_price,
         regr_slope(modal_price, day_index) AS s, regr_intercept(modal_price, day_index) AS ic,
         max(day_index) AS last_day
  FROM indexed GROUP BY {keys}
),
stats AS (
  SELECT *, CASE WHEN n >= 3 THEN s END AS slope, CASE WHEN n >= 3 THEN ic END AS intercept,
         CASE WHEN n >= 3 THEN s * (last_day + 14) + ic END AS forecast_14d,
         CASE WHEN earliest_price = 0 THEN 0
              ELSE (latest_price - earliest_price) / earliest_price * 100 END AS percent_change,
         CASE WHEN n >= 3 AND s > 0.5 THEN 'upward' WHEN n >= 3 AND s < -0.5 THEN 'downward'
              ELSE 'stable' END AS trend_direction
  FROM fitted
)"""


# Averages of two-place prices often end in a 5 just past the rounding place. Such
# a tie would be settled by the order of a floating-point sum, which neither
# engine fixes, so values are moved off it by far less than they are rounded.
NUDGES = {4: 3.183e-8, 6: 3.183e-10}


def settled(value: Column, places: int) -> Column:
    return F.round(value + F.lit(NUDGES[places]), places)


def two_places(expression: str) -> str:
    return f"CAST(printf('%.2f', {expression}) AS double)"


# --- texts ----------------------------------------------------------------

# Letters of the test texts, and the Indic characters that stand in for them:
# one letter of each script, a Tamil vowel sign and a Devanagari digit.
LATIN = "éèçêäüößóñí"
INDIC = "हকਕગதతಕଓമா८"


def indic(text: Column) -> Column:
    return F.translate(text, LATIN, INDIC)


def indic_sql(text: str) -> str:
    return f"translate({text}, '{LATIN}', '{INDIC}')"


# Words of the test texts as aliases of the names in the test tables.
SAMPLE_COMMODITIES = [
    ("that", "STANDARD"), ("was", "STANDARD"), ("que", "PROMO"), ("une", "PROMO"),
    ("und", "LARGE"), ("die", "LARGE"), ("los", "SMALL"), ("por", "SMALL"),
    ("from", "MEDIUM"), ("with", "A"),
]
SAMPLE_LOCATIONS = [
    ("this", "NATION_1"), ("des", "NATION_7"), ("der", "NATION_12"), ("una", "NATION_20"),
    ("by", "EUROPE"), ("are", "Supplier#00000000"),
]
SAMPLE_RULES = [
    (1, "tion", "rag_agent"), (1, "chkeit", "rag_agent"), (1, "for", "rag_agent"),
    (2, "th", "price_agent"), (2, "ier", "price_agent"), (2, "ung", "price_agent"),
    (3, "\n", "price_agent"),
]
SAMPLE = Vocabulary(
    commodities=SAMPLE_COMMODITIES,
    locations=SAMPLE_LOCATIONS,
    default_commodity="ECONOMY",
    rules=SAMPLE_RULES,
)
EDGE = r"[^\p{L}\p{N}_]"


def alias_case(text: str, aliases: list[tuple[str, str]], default: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(lower({text}), '(^|{EDGE}){alias}($|{EDGE})') THEN '{name}'"
        for alias, name in aliases
    )
    return f"CASE {whens} ELSE {default} END"


def keyword_case(text: str, rules: list[tuple[int, str, str]], default: str = "rag_agent") -> str:
    whens = " ".join(
        f"WHEN contains(lower({text}), '{word}') THEN '{label}'"
        for _, word, label in sorted(rules, key=lambda rule: rule[0])
    )
    return f"CASE {whens} ELSE '{default}' END"


def letter_language_sql(text: str) -> str:
    letters = r"\x{0900}-\x{097F}\x{0C00}-\x{0C7F}\x{0C80}-\x{0CFF}\x{0B80}-\x{0BFF}" \
              r"\x{0A00}-\x{0A7F}\x{0A80}-\x{0AFF}\x{0980}-\x{09FF}"
    first = (
        f"regexp_extract(regexp_replace({text}, '[^\\p{{Lo}}]', '', 'g'), '[{letters}]')"
    )
    return f"""CASE
      WHEN {first} = '' THEN 'en'
      WHEN regexp_matches({first}, '[\\x{{0900}}-\\x{{097F}}]') THEN 'hi'
      WHEN regexp_matches({first}, '[\\x{{0980}}-\\x{{09FF}}]') THEN 'bn'
      WHEN regexp_matches({first}, '[\\x{{0A00}}-\\x{{0A7F}}]') THEN 'pa'
      WHEN regexp_matches({first}, '[\\x{{0A80}}-\\x{{0AFF}}]') THEN 'gu'
      WHEN regexp_matches({first}, '[\\x{{0B80}}-\\x{{0BFF}}]') THEN 'ta'
      WHEN regexp_matches({first}, '[\\x{{0C00}}-\\x{{0C7F}}]') THEN 'te'
      ELSE 'kn' END"""


# --- questions ------------------------------------------------------------


def qid() -> Column:
    return F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


QID = "CAST(conv_id AS varchar) || '-' || CAST(turn AS varchar)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages, in stand-in scripts."""
    messages = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return messages.select(qid().alias("qid"), indic(F.col("text")).alias("question"))


def all_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        qid().alias("qid"), F.col("text").alias("question")
    )


def model_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as a model might give them: clean, quoted, unknown or none."""
    turn = F.col("turn")
    raw = (
        F.when(turn == 0, F.lit(' "Price_Agent" '))
        .when(turn == 1, F.lit("'rag_agent'\n"))
        .when(turn == 2, F.lit("not_a_real_label"))
        .when(turn == 3, F.lit("price_agent"))
    )
    return table(spark, sf_dir, "conversations").select(qid().alias("qid"), raw.alias("raw_label"))


LABEL = "CASE turn WHEN 0 THEN 'price_agent' WHEN 1 THEN 'rag_agent' WHEN 3 THEN 'price_agent' END"


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant message that follows a user message is its model answer."""
    messages = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    asked = F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    return messages.select(asked.alias("qid"), F.col("text").alias("raw_answer"))


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question has the vector whose id is its conversation's, if there is one."""
    messages = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("conv_id"), "embedding"
    )
    return messages.select("conv_id", "turn").join(vectors, "conv_id").select(
        qid().alias("qid"), "embedding"
    )


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk: title line and whole text."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.substring_index("text", "\n", 1).alias("scheme"),
        "text",
    )


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("chunk_id"), "embedding"
    )


def document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their vectors, stored, as a search reads them more than once.

    Only documents that have a vector are shuffled, if the ids of these can be broadcast.
    """
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    chunks = document_chunks(spark, sf_dir)
    if is_small(ids, MAX_BROADCAST_BYTES):  # bounded in bytes
        named = ids.select(F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("chunk_id"))
        chunks = chunks.join(F.broadcast(named), "chunk_id", "left_semi")
    return stage(chunks.join(chunk_vectors(spark, sf_dir), "chunk_id"), "index")


def sql_string(text: str) -> str:
    """A Python string as a SQL literal."""
    return "'" + text.replace("'", "''") + "'"


DISTANCE = (
    "list_sum(list_transform(list_zip(CAST(q.embedding AS double[]), CAST(c.embedding AS double[])),"
    " lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
)

RETRIEVED = f"""
questions AS (
  SELECT conv_id, turn, {QID} AS qid, {indic_sql('text')} AS question
  FROM conversations WHERE role = 'user'
),
chunk_index AS (
  SELECT 'doc_' || CAST(doc_id AS varchar) AS chunk_id, text, embedding
  FROM documents JOIN embeddings ON doc_id = vec_id
),
asked_vectors AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IN (SELECT conv_id FROM conversations WHERE role = 'user')
),
ranked AS (
  SELECT q.vec_id, c.chunk_id, c.text, {DISTANCE} AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, c.chunk_id) AS rank
  FROM asked_vectors q CROSS JOIN chunk_index c
),
hits AS (SELECT * FROM ranked WHERE rank <= 3),
contexts AS (
  SELECT vec_id, string_agg(text, E'\\n\\n---\\n\\n' ORDER BY rank) AS context,
         count(*) AS n_chunks
  FROM hits GROUP BY vec_id
),
asked AS (
  SELECT qid, conv_id, turn, question, coalesce(context, '') AS context,
         coalesce(n_chunks, 0) AS n_chunks
  FROM questions LEFT JOIN contexts ON conv_id = vec_id
)"""
