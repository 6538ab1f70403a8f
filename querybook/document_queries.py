"""Queries of the chunker, the index, retrieval, context and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestline.functions import render
from harvestline.functions import text as X
from harvestline.operators import chunking as K
from harvestline.operators import context as C
from harvestline.operators import nearest as N
from harvestline.session import new_folder, stage
from harvestline.sources import documents as D

from . import Query
from . import views as V


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are: one section each, one paragraph per line."""
    chunks = K.chunk_documents(V.table(spark, sf_dir, "documents"), paragraph_break="\n")
    return chunks.withColumn("ordinal", F.col("ordinal").cast("bigint"))


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with blank-line paragraphs and dash-line sections put in."""
    documents = V.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.regexp_replace(
            F.regexp_replace("text", "\n", "\r\n \t\r\n"), " [|] ", "\n-----\n"
        ).alias("text"),
    )
    return K.chunk_documents(documents).select(
        "doc_id", "chunk_id", "scheme", F.col("ordinal").cast("bigint").alias("ordinal"), "text"
    )


def _chunks_sql(text: str, section: str, paragraph: str) -> str:
    white = V.sql_string(X.WHITESPACE)
    return f"""WITH sections AS (
  SELECT doc_id, trim(unnest(regexp_split_to_array(trim({text}, {white}), '{section}')), {white}) AS section
  FROM documents
),
titled AS (
  SELECT doc_id, trim(split_part(section, E'\\n', 1), {white}) AS scheme,
         CASE WHEN contains(section, E'\\n') THEN section[instr(section, E'\\n') + 1:] ELSE '' END AS body
  FROM sections WHERE section <> ''
),
parted AS (
  SELECT doc_id, scheme, list_filter(list_transform(regexp_split_to_array(body, '{paragraph}'),
         lambda p: trim(p, {white})), lambda p: p <> '') AS parts
  FROM titled
),
listed AS (
  SELECT doc_id, scheme, unnest(range(len(parts))) AS ordinal, unnest(parts) AS text FROM parted
)
SELECT doc_id, CAST(doc_id AS varchar) || '_' || trim(regexp_replace(lower(trim(split_part(scheme,
         '(', 1), {white})), '[^a-z0-9]+', '_', 'g'), '_') || '_' || CAST(ordinal AS varchar) AS chunk_id,
       scheme, ordinal, text"""


def _values() -> Column:
    """A vector's entries in millionths, rounded down, as one text."""
    numbers = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * 1_000_000).cast("string"))
    return F.array_join(numbers, ",").alias("vector")


def index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = D.join_vectors(V.document_chunks(spark, sf_dir), V.chunk_vectors(spark, sf_dir))
    return joined.select("chunk_id", "scheme", "text", _values())


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index checked, written and opened again."""
    built = D.build_index(
        V.document_chunks(spark, sf_dir), V.chunk_vectors(spark, sf_dir), new_folder(spark, "index")
    )
    return built.select("chunk_id", "scheme", "text", _values())


def chunk_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into chunks, joined with vectors, written as an index, opened and searched."""
    chunks = K.chunk_documents(V.table(spark, sf_dir, "documents"), paragraph_break="\n")
    chunks = stage(chunks.select("chunk_id", "doc_id", "ordinal", "scheme", "text"), "chunks")
    vectors = V.table(spark, sf_dir, "embeddings")
    of = (F.col("doc_id") * 7 + F.col("ordinal")) % 400
    given = chunks.select("chunk_id", of.alias("vec_id")).join(vectors, "vec_id").select("chunk_id", "embedding")
    index = D.build_index(chunks.select("chunk_id", "scheme", "text"), given, new_folder(spark, "index"))
    questions = vectors.where(F.col("vec_id") % 10 == 3).select(F.col("vec_id").alias("qid"), "embedding")
    return N.neighbours(N.retrieve(questions, index, 3)).withColumn("distance", F.round("distance", 9))


def index_missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.missing_vectors(
        V.document_chunks(spark, sf_dir), V.chunk_vectors(spark, sf_dir)
    ).select("chunk_id", "scheme")


def _every_vector(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = V.table(spark, sf_dir, "embeddings")
    return (
        vectors.select(F.col("vec_id").alias("qid"), "embedding"),
        vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"),
    )


def _neighbours(retrieved: DataFrame) -> DataFrame:
    rows = N.neighbours(N.without_self(retrieved, 3))
    return rows.withColumn("distance", F.round("distance", 9))


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest other vectors of every vector; small-index way."""
    questions, index = _every_vector(spark, sf_dir)
    return _neighbours(N.retrieve(questions, index, 4))


def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the cell join, the way of an index too large to ship."""
    questions, index = _every_vector(spark, sf_dir)
    return _neighbours(N.retrieve_by_cells(questions, index, 4))


KNN = f"""
WITH ranked AS (
  SELECT q.vec_id AS qid, c.vec_id AS chunk_id, {V.DISTANCE} AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, c.vec_id) AS rank
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id
)
SELECT qid, chunk_id, rank, round(distance, 9) AS distance FROM ranked WHERE rank <= 3"""


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User questions with the hits of their vector, empty where they have none."""
    asked = V.questions(spark, sf_dir).join(V.question_vectors(spark, sf_dir), "qid", "left")
    return N.retrieve(asked, V.document_index(spark, sf_dir))


def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_context(_retrieved(spark, sf_dir)).select(
        "qid", "context", F.size("retrieved_chunks").cast("bigint").alias("n_chunks")
    )


def rag_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sources(_retrieved(spark, sf_dir))


def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = C.with_context(_retrieved(spark, sf_dir)).withColumn(
        "language", X.language_by_first_letter(F.col("question"))
    )
    return C.with_prompt(asked).select("qid", "language", "prompt")


def rag_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = V.questions(spark, sf_dir).join(V.model_answers(spark, sf_dir), "qid", "left")
    language = X.language_by_first_letter(F.col("question"))
    return asked.select(
        "qid", render.scheme_answer(F.col("raw_answer"), language).alias("answer")
    )


LANGUAGE_NAME = """CASE language WHEN 'hi' THEN 'Hindi (Devanagari script)'
  WHEN 'kn' THEN 'Kannada (Kannada script)' WHEN 'te' THEN 'Telugu (Telugu script)'
  WHEN 'ta' THEN 'Tamil (Tamil script)' WHEN 'pa' THEN 'Punjabi (Gurmukhi script)'
  WHEN 'gu' THEN 'Gujarati (Gujarati script)' WHEN 'bn' THEN 'Bengali (Bengali script)'
  ELSE 'English' END"""


def prompt_sql(template: str) -> str:
    text = V.sql_string(template)
    for name, value in (
        ("language", LANGUAGE_NAME), ("context", "context"), ("question", "question")
    ):
        text = text.replace("{" + name + "}", f"' || {value} || '")
    return text


BUSY = """CASE language WHEN 'hi' THEN 'क्षमा करें, सर्वर व्यस्त है। कृपया कुछ क्षण बाद पुनः प्रयास करें।'
  WHEN 'pa' THEN 'ਮਾਫ ਕਰਨਾ, ਸਰਵਰ ਵਿਅਸਤ ਹੈ। ਕਿਰਪਾ ਕਰਕੇ ਬਾਅਦ ਵਿੱਚ ਕੋਸ਼ਿਸ਼ ਕਰੋ।'
  WHEN 'kn' THEN 'ಕ್ಷಮಿಸಿ, ಸರ್ವರ್ ಬಿಡುವಿಲ್ಲದಿದೆ. ದಯವಿಟ್ಟು ಸ್ವಲ್ಪ ಸಮಯದ ನಂತರ ಪ್ರಯತ್ನಿಸಿ.'
  ELSE 'Sorry, the server is busy. Please try again later.' END"""
MODEL = f"""model AS (
  SELECT CAST(conv_id AS varchar) || '-' || CAST(turn - 1 AS varchar) AS qid, text AS raw_answer
  FROM conversations WHERE role = 'assistant'
)"""
SPOKEN = f"spoken AS (SELECT *, {V.letter_language_sql('question')} AS language FROM asked)"


def _prompts() -> str:
    from harvestline import lexicon

    return (
        f"CASE WHEN context <> '' THEN {prompt_sql(lexicon.GROUNDED_PROMPT)}"
        f" ELSE {prompt_sql(lexicon.UNGROUNDED_PROMPT)} END"
    )


PROMPT = _prompts()
_INDEX = (
    " FROM (SELECT 'doc_' || CAST(doc_id AS varchar) AS chunk_id,"
    " split_part(text, E'\\n', 1) AS scheme, text, doc_id FROM documents)"
)

_JOINED = (
    "SELECT chunk_id, scheme, text, array_to_string(list_transform(embedding,"
    " lambda x: CAST(floor(CAST(x AS double) * 1000000) AS bigint)), ',') AS vector"
    f"{_INDEX} JOIN embeddings ON doc_id = vec_id"
)

QUERIES = {
    "doc_chunks": Query(
        doc_chunks,
        _chunks_sql("text", r"\n-{3,}\n", r"\n")
        + ", scheme || E'\\n\\n' || text AS embed_text FROM listed",
    ),
    "chunk_ids": Query(
        chunk_ids,
        _chunks_sql(
            "replace(replace(text, E'\\n', E'\\n \\t\\n'), ' | ', E'\\n-----\\n')",
            r"\n-{3,}\n", r"\n[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*\n",
        )
        + " FROM listed",
    ),
    "index_join": Query(index_join, _JOINED),
    "index_build": Query(index_build, _JOINED),
    "chunk_retrieval": Query(
        chunk_retrieval,
        _chunks_sql("text", r"\n-{3,}\n", r"\n").replace("\nSELECT doc_id, CAST(doc_id", ",\nchunked AS (SELECT doc_id, CAST(doc_id")
        + f""" FROM listed),
given AS (SELECT chunk_id, embedding FROM chunked JOIN embeddings ON vec_id = (doc_id * 7 + ordinal) % 400),
asked AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 10 = 3),
ranked AS (
  SELECT q.vec_id AS qid, c.chunk_id, {V.DISTANCE} AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, c.chunk_id) AS rank
  FROM asked q CROSS JOIN given c
)
SELECT qid, chunk_id, rank, round(distance, 9) AS distance FROM ranked WHERE rank <= 3""",
    ),
    "index_missing_vectors": Query(
        index_missing_vectors,
        f"SELECT chunk_id, scheme{_INDEX} WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    ),
    "knn_topk": Query(knn_topk, KNN),
    "knn_cells": Query(knn_cells, KNN),
    "rag_context": Query(
        rag_context, f"WITH {V.RETRIEVED} SELECT qid, context, n_chunks FROM asked"
    ),
    "rag_sources": Query(
        rag_sources,
        f"WITH {V.RETRIEVED} SELECT qid, rank AS source_no, 'Source ' || CAST(rank AS varchar)"
        f" AS label, trim(text, {V.sql_string(X.WHITESPACE)}) AS text"
        " FROM questions JOIN hits ON conv_id = vec_id",
    ),
    "rag_prompt": Query(
        rag_prompt,
        f"WITH {V.RETRIEVED}, {SPOKEN} SELECT qid, language, {PROMPT} AS prompt FROM spoken",
    ),
    "rag_answer": Query(
        rag_answer,
        f"WITH asked AS (SELECT {V.QID} AS qid, {V.indic_sql('text')} AS question"
        f" FROM conversations WHERE role = 'user'), {SPOKEN}, {MODEL}"
        f" SELECT s.qid, coalesce(nullif(raw_answer, ''), {BUSY}) AS answer"
        " FROM spoken s LEFT JOIN model m ON s.qid = m.qid",
    ),
}
