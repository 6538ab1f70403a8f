"""Questions as a stream; answers equal those of a batch over the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import nearest as N
from ..plans import answers as A
from ..plans import prices as P
from ..sources import prices as L
from ..sources import versions


def price_answers(
    questions: DataFrame, records: DataFrame, vocabulary: A.Vocabulary = A.DEFAULT
) -> DataFrame:
    """Stateless stream: routing columns, then a stream-static join.

    Questions routed to documents come out without retrieval; use
    :func:`batch_answerer` where vectors are at hand.
    """
    asked = A.understand(questions, vocabulary)
    for name, type_ in (("raw_answer", "string"), ("prompt", "string")):
        if name not in asked.columns:
            asked = asked.withColumn(name, F.lit(None).cast(type_))
    if "retrieved_chunks" not in asked.columns:
        asked = asked.withColumn("retrieved_chunks", F.array().cast("array<string>"))
    return A.finish(A.join_records(asked, records))


def batch_answerer(path: str, **inputs) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the batch plan on each micro-batch.

    The index is opened once. ``prices`` may be the path of a stored price table:
    each batch then answers from the newest version there is when it begins, and
    from that one only; what all batches share is computed anew when the version
    has changed. Prices given as a table are read once, as they are at the start.
    The price records of a vocabulary with few pairs are shared; with more, each
    batch takes those it asks. Every batch replaces its own folder, so a batch that
    is run again after a failure leaves one copy of its answers.
    """
    if isinstance(inputs.get("index"), DataFrame):
        inputs["index"] = N.open_index(inputs["index"])
    vocabulary = inputs.get("vocabulary", A.DEFAULT)
    stored = inputs.pop("prices") if isinstance(inputs.get("prices"), str) else None
    if stored is None and inputs.get("records") is None:
        inputs = _shared(inputs, vocabulary)
    shared: dict = {"version": None, "inputs": inputs}

    def answer(batch: DataFrame, batch_id: int) -> None:
        if stored is not None:
            spark = batch.sparkSession
            version = versions.pinned(spark, stored)
            if shared["version"] != version:
                table = {
                    "prices": L.open_prices(spark, stored, version=version),
                    "dims": L.open_catalogue(spark, stored, version),
                }
                shared.update(version=version, inputs=_shared({**inputs, **table}, vocabulary))
        A.answer_questions(batch, **shared["inputs"]).write.mode("overwrite").parquet(
            f"{path}/batch_id={batch_id}"
        )

    return answer


def _shared(inputs: dict, vocabulary: A.Vocabulary) -> dict:
    """Inputs with what all batches of one price version can share."""
    if inputs.get("cube") is None and inputs.get("dims") is None:
        # Batches must not read different states of a table that has no versions.
        inputs = {**inputs, "cube": P.daily_cube(inputs["prices"])}
    facts = {name: inputs.get(name) for name in ("prices", "cube", "dims")}
    if not A.crossable(vocabulary):
        return {**inputs, **facts}
    records = A.vocabulary_records(facts["prices"], None, vocabulary, facts["cube"], facts["dims"])
    return {**{k: v for k, v in inputs.items() if k not in facts}, "records": records}


def drain(writer: DataStreamWriter, checkpoint: str) -> None:
    """Run a stream over all input there is, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
