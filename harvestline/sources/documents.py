"""Scheme documents and the chunk index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from . import versions
from .versions import Version

CHUNKS = "chunks"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each file under ``path`` as one row (doc_id, text)."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def duplicate_ids(chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Chunk ids that occur more than once."""
    return (
        chunks.groupBy(id_col).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)
    )


def join_vectors(chunks: DataFrame, vectors: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Chunks with their vectors; ids are unique, so no key can be hot."""
    return chunks.join(vectors, id_col)


def missing_vectors(chunks: DataFrame, vectors: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Chunks that have no vector."""
    return chunks.join(vectors, id_col, "left_anti")


def build_index(
    chunks: DataFrame, vectors: DataFrame, path: str, id_col: str = "chunk_id"
) -> DataFrame:
    """Replace the whole index with chunks ⋈ vectors.

    Fails before any of the index is written if an id repeats on either side or the
    vectors differ in width. Readers keep the earlier index until the new one
    is whole.
    """
    # Both sides are read several times, and may take long to compute.
    chunks, vectors = stage(chunks, "index-chunks"), stage(vectors, "index-vectors")
    for side, name in ((chunks, "chunk"), (vectors, "vector")):
        repeated = [row[0] for row in duplicate_ids(side, id_col).limit(5).collect()]
        if repeated:
            raise ValueError(f"{name} ids repeat, for example {repeated}")
    widths = vectors.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if widths[0] != widths[1]:
        raise ValueError(f"vector widths differ: {widths[0]} to {widths[1]}")
    version = versions.replace(join_vectors(chunks, vectors, id_col), path, CHUNKS)
    return open_index(chunks.sparkSession, path, version)


def open_index(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """The stored index; ``version`` pins what is read, else that is the newest now."""
    pinned = version or versions.pinned(spark, path)
    return spark.read.parquet(*pinned.folders(CHUNKS))
