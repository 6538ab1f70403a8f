"""The answer plan, its streams, and the conversation log."""

import datetime as dt
import json
import os
from types import SimpleNamespace

import pytest
from conftest import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from harvestline import lexicon, session
from harvestline.operators import ranking as K
from harvestline.plans import answers as A
from harvestline.plans import prices as P
from harvestline.session import CHECKPOINT_CONF, new_folder, shared_folder
from harvestline.sources import conversations as G
from harvestline.sources import prices as L
from harvestline.sources import questions as Q
from harvestline.streaming import answers as R

ASKED = [
    (0, "  What is the trend of wheat prices in Indore? ", None),
    (1, "Average price of tomato in Bhopal?", None),
    (2, "क्या मैं PMFBY फसल बीमा ले सकता हूँ?", None),
    (3, "Show all crop prices in Punjab", "hi"),
    (4, " \n ", None),
    (5, "some ambiguous PMFBY-adjacent question", None),
    (6, "hello how are you", ""),
]


@pytest.fixture(scope="module")
def prices(spark):
    facts = [("Wheat", "Indore", "MP", n, 2000.0 + 10 * n) for n in range(5)]
    facts += [("Tomato", "Pune", "Maharashtra", n, 900.0) for n in range(2)]
    return spark.createDataFrame(
        [(dt.date(2024, 1, 1 + n), c, m, s, p) for c, m, s, n, p in facts],
        "date date, commodity string, market string, state string, modal_price double",
    )


@pytest.fixture(scope="module")
def inputs(spark, prices):
    index = spark.createDataFrame(
        [("a", "Cover", "crop insurance", [1.0, 0.0]), ("b", "Aid", "income support", [0.0, 1.0])],
        "chunk_id string, scheme string, text string, embedding array<float>",
    )
    return {
        "index": index,
        "vectors": spark.createDataFrame(
            [(2, [1.0, 0.1]), (0, [1.0, 0.0])], "qid long, embedding array<float>"
        ),
        "labels": spark.createDataFrame(
            [(5, ' "price_agent"\n'), (0, "not_a_real_label")], "qid long, raw_label string"
        ),
        "model_answers": spark.createDataFrame([(2, "हाँ")], "qid long, raw_answer string"),
        "prices": prices,
    }


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "qid long, question string, language string")


def test_every_question_is_answered(spark, asked, inputs):
    found = {row["qid"]: row for row in A.answer_questions(asked, k=1, **inputs).collect()}
    assert len(found) == len(ASKED)

    wheat = found[0]
    assert (wheat["routed_to"], wheat["badge"]) == ("price_agent", "Mandi Prices & Analytics")
    assert wheat["question"] == "What is the trend of wheat prices in Indore?"
    assert wheat["answer_text"] == (
        "Average modal price: **₹2,020.00** per quintal.\n\n🔮 **14-Day Trend Forecast:** "
        "₹2180.0/quintal (upward trajectory)."
    )
    assert wheat["scheme"] is None and wheat["prompt"] is None
    assert wheat["price"]["stats_scope"] == "located" and wheat["price"]["market"] == "Indore"
    assert wheat["price"]["forecast_stats"]["percent_change"] == 2.0

    # No tomato in Bhopal: no headline, but statistics of all regions.
    tomato = found[1]
    assert tomato["answer_text"] == lexicon.NO_DATA_TEXT
    assert tomato["price"]["stats_scope"] == "all"
    assert tomato["price"]["forecast_stats"]["latest_price"] == 900.0
    assert tomato["price"]["forecast_stats"]["forecast_14d"] is None

    scheme = found[2]
    assert (scheme["routed_to"], scheme["language"], scheme["answer_text"]) == ("rag_agent", "hi", "हाँ")
    assert scheme["scheme"].asDict() == {
        "question": ASKED[2][1], "retrieved_chunks": ["crop insurance"], "answer": "हाँ",
    }
    assert "crop insurance" in scheme["prompt"] and scheme["price"] is None

    assert found[3]["language"] == "hi" and found[3]["price"]["asked_location"] == "Punjab"
    rejected = found[4]
    assert rejected["error"] == lexicon.EMPTY_QUESTION_ERROR
    assert rejected["routed_to"] is None and rejected["answer_text"] is None
    assert found[5]["routed_to"] == "price_agent"  # the model's label wins
    assert found[5]["answer_text"].startswith("Average modal price: **₹2,020.00**")
    assert found[6]["answer_text"] == lexicon.DEFAULT_BUSY_TEXT
    assert found[6]["scheme"]["retrieved_chunks"] == []
    assert "No reference document context" in found[6]["prompt"]


def test_answers_without_models_or_index(spark, asked, prices):
    found = A.answer_questions(asked, prices).where("routed_to = 'rag_agent'").collect()
    assert {row["qid"] for row in found} == {2, 5, 6}
    assert all(row["scheme"]["retrieved_chunks"] == [] for row in found)


def test_large_gazetteer_reads_pairs_off_the_questions(spark, asked, prices, monkeypatch):
    small = A.vocabulary_records(prices, asked, A.DEFAULT)
    monkeypatch.setattr(A, "MAX_LISTED_PAIRS", 0)
    with pytest.raises(ValueError, match="pass the questions"):
        A.vocabulary_records(prices, None, A.DEFAULT)
    large = A.vocabulary_records(prices, asked, A.DEFAULT)
    assert rows(large) and all(row in rows(small) for row in rows(large))
    answered = A.answer_questions(asked, records=large)
    assert rows(answered) == rows(A.answer_questions(asked, records=small))


def test_unreadable_requests_are_reported(spark, tmp_path, prices):
    with open(os.path.join(tmp_path, "q.json"), "w", encoding="utf-8") as file:
        file.write(json.dumps({"qid": 1, "question": "wheat price"}) + "\n{broken\n")
    found = A.answer_questions(Q.read_questions(spark, str(tmp_path)), prices).collect()
    by_id = {row["qid"]: row for row in found}
    assert by_id[1]["routed_to"] == "price_agent" and by_id[1]["error"] is None
    broken = by_id[None]
    assert (broken["routed_to"], broken["badge"]) == ("error", "System Error")
    assert broken["answer_text"] == lexicon.SYSTEM_ERROR_TEXT
    assert "{broken" in broken["error"]
    out = new_folder(spark, "answers")
    Q.write_answers(A.answer_questions(Q.read_questions(spark, str(tmp_path)), prices), out)
    assert spark.read.parquet(out).count() == 2


def question_files(folder):
    for qid, question, language in ASKED:
        with open(os.path.join(folder, f"{qid}.json"), "w", encoding="utf-8") as file:
            file.write(json.dumps({"qid": qid, "question": question, "language": language}))
    return str(folder)


def test_stream_equals_batch(spark, tmp_path, prices):
    folder = question_files(tmp_path)
    records = A.vocabulary_records(prices, Q.read_questions(spark, folder), A.DEFAULT)
    streamed = R.price_answers(Q.stream_questions(spark, folder, 2), records)
    out = new_folder(spark, "stream")
    R.drain(
        streamed.writeStream.format("parquet").option("path", out), new_folder(spark, "state")
    )
    batch = A.answer_questions(Q.read_questions(spark, folder), records=records)
    columns = ["qid", "language", "routed_to", "answer_text", "price", "error"]
    assert rows(spark.read.parquet(out), *columns) == rows(batch, *columns)


def test_micro_batches_equal_batch(spark, tmp_path, inputs):
    folder = question_files(tmp_path)
    out = new_folder(spark, "stream")
    answerer = R.batch_answerer(out, **inputs)
    stream = Q.stream_questions(spark, folder, 3)
    R.drain(stream.writeStream.foreachBatch(answerer), new_folder(spark, "state"))
    batch = A.answer_questions(Q.read_questions(spark, folder), **inputs)
    stored = spark.read.parquet(out)
    assert stored.select("batch_id").distinct().count() == 3
    assert rows(stored, *batch.columns) == rows(batch)
    # A repeated batch replaces its own answers.
    answerer(Q.read_questions(spark, folder).where("qid < 3"), 0)
    assert spark.read.parquet(out).where("batch_id = 0").count() == 3


def test_message_stream_reads_a_folder_of_files(spark, tmp_path):
    """A table is one file or a folder of part files; both give all user messages (F2)."""
    from querybook import answer_queries as AQ

    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c in range(5) for t in range(4)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    os.makedirs(whole)
    table.toPandas().to_parquet(f"{whole}/conversations.parquet")
    table.repartition(3).write.parquet(f"{parts}/conversations.parquet")
    found = []
    for folder in (whole, parts):
        out = new_folder(spark, "messages")
        stream = AQ._message_stream(spark, folder)
        R.drain(stream.writeStream.format("parquet").option("path", out), new_folder(spark, "state"))
        found.append(rows(spark.read.schema(stream.schema).parquet(out), "qid"))
    assert found[0] == found[1] and len(found[0]) == 10


def test_one_answer_per_question_whatever_the_models_repeat(spark, asked, prices):
    ids = [row["qid"] for row in asked.select("qid").collect()]
    labels = spark.createDataFrame([(q, l) for q in ids for l in ("scheme_rag", "price_agent")], "qid int, raw_label string")
    texts = spark.createDataFrame([(q, t) for q in ids for t in ("b", "a")], "qid int, raw_answer string")
    found = A.answer_questions(asked, prices, labels=labels, model_answers=texts)
    assert found.count() == len(ids)


def test_unreadable_prices_give_price_questions_their_error(spark, asked, prices):
    broken = prices.withColumn("modal_price", F.raise_error(F.lit("disk gone")).cast("double"))
    found = A.answer_questions(asked, broken).collect()
    priced = [row for row in found if row["routed_to"] == "price_agent"]
    assert priced and all("disk gone" in row["price"]["error"] for row in priced)
    assert all(row["answer_text"].startswith("⚠️") for row in priced)
    others = [row for row in found if row["routed_to"] == lexicon.SCHEME_ROUTE]
    assert others and all(row["price"] is None for row in others)


def test_defects_of_the_plan_are_raised(spark, asked, prices):
    with pytest.raises(AnalysisException, match="modal_price"):
        A.answer_questions(asked, prices.drop("modal_price"))
    missing = new_folder(spark, "never-written")
    found = A.answer_questions(asked, missing).where("routed_to = 'price_agent'").collect()
    assert found and all(missing in row["price"]["error"] for row in found)


def test_batches_see_the_newest_prices_each_one_version(spark, tmp_path, asked, prices):
    """A load between two batches: the first answers from the old table and the second from the new one."""
    table, out = new_folder(spark, "prices"), new_folder(spark, "stream")
    full = prices.withColumns({c: F.lit(None).cast("double") for c in ("min_price", "max_price")})
    L.write_prices(full, table)
    answerer = R.batch_answerer(out, prices=table)
    answerer(asked, 0)
    answerer(asked, 1)
    L.write_prices(full.withColumn("modal_price", F.col("modal_price") + 1000), table)
    answerer(asked, 2)
    texts = {b: {r["qid"]: r["answer_text"] for r in spark.read.parquet(f"{out}/batch_id={b}").collect()} for b in range(3)}
    assert texts[0] == texts[1] and "2,020.00" in texts[0][0] and "3,020.00" in texts[2][0]
    stores = set(spark.read.parquet(out).where("batch_id = 2 and routed_to = 'price_agent'").select("price.modal_price").toPandas()["modal_price"].dropna())
    assert all(value > 1900 for value in stores)


def test_refresh_joins_its_facts_once(spark, tmp_path, monkeypatch):
    """Both loads write facts that were joined and stored before (F9)."""
    from querybook import answer_queries as AQ

    tables = {
        "lineitem": "1L AS l_partkey, 1L AS l_suppkey, DATE'2024-01-01' AS l_shipdate, 10D AS l_extendedprice, 2D AS l_quantity",
        "part": "1L AS p_partkey, 'Wheat' AS p_type",
        "supplier": "1L AS s_suppkey, 1L AS s_nationkey, 'Indore' AS s_name",
        "nation": "1L AS n_nationkey, 'MP' AS n_name",
        "conversations": "1L AS conv_id, 0L AS turn, 'user' AS role, 'wheat' AS text",
    }
    for name, columns in tables.items():
        spark.sql(f"SELECT {columns}").write.parquet(str(tmp_path / f"{name}.parquet"))
    loads = []
    monkeypatch.setattr(AQ.L, "write_prices", lambda load, table: loads.append(load))
    monkeypatch.setattr(AQ.R, "batch_answerer", lambda *a, **b: lambda batch, batch_id: None)
    with pytest.raises(AnalysisException):  # nothing was answered
        AQ.answer_stream_refresh(spark, str(tmp_path))
    assert [load.count() for load in loads] == [1, 1]
    assert not any("Join" in load._jdf.queryExecution().optimizedPlan().toString() for load in loads)


def test_replay_keeps_rows_without_turn_or_conversation(spark):
    log = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, None, "user", "b"), (None, 0, "user", "c"), (1, 0, "bot", "d")],
        "conv_id long, turn long, role string, text string",
    )
    found = rows(G.replay(log), "conv_id", "text", "position")
    assert found == sorted([(1, "b", 0), (1, "d", 1), (1, "a", 2), (None, "c", 0)], key=repr)


# --- conversations --------------------------------------------------------


def test_replay_of_a_hot_conversation(spark):
    turns = [(1, 3 * n) for n in range(50)] + [(2, 7), (2, 1), (3, 0)]
    log = spark.createDataFrame(turns, "conv_id long, turn long").repartition(5)
    expected = [(1, 3 * n, n) for n in range(50)] + [(2, 1, 0), (2, 7, 1), (3, 0, 0)]
    assert rows(G.replay(log), "conv_id", "turn", "position") == sorted(expected, key=repr)


@pytest.fixture
def uneven(spark):
    """Small partitions stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_replay_of_equal_turns_uses_many_tasks(spark, uneven, monkeypatch):
    """Two thirds of the log are one conversation of one turn; a third of that repeats one row."""
    log = spark.createDataFrame(
        [(1, 0, "user", "same") for _ in range(400)] + [(1, 0, "user", f"{n:04}") for n in range(800)]
        + [(n // 2, n % 2, "bot", "x") for n in range(600)] + [(None, None, None, None), (None, 1, None, "z")],
        "conv_id long, turn long, role string, text string",
    ).repartition(7)
    written = []
    monkeypatch.setattr(K, "stage", lambda df, name: written.append(session.stage(df, name)) or written[-1])
    found = rows(G.replay(log), "conv_id", "turn", "role", "text", "position")
    expected, last = [], {}
    first = (lambda v: (v is not None, v if v is not None else 0), lambda v: (v is not None, v or ""))
    for row in sorted((tuple(r) for r in log.collect()), key=lambda r: (first[0](r[0]), first[0](r[1]), first[1](r[2]), first[1](r[3]))):
        last[row[0]] = last.get(row[0], -1) + 1
        expected.append((*row, last[row[0]]))
    assert found == sorted(expected, key=repr)
    tasks = [r["n"] for r in written[0].where("conv_id = 1").groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(tasks) >= 8 and max(tasks) < 400


def test_append_and_clear(spark):
    schema = "conv_id long, turn long, role string, text string"
    first = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "b")], schema)
    path = G.rewrite_log(first)
    G.append_messages(spark.createDataFrame([(1, 1, "assistant", "c")], schema), path)
    log = G.open_log(spark, path)
    assert rows(G.replay(log), "conv_id", "position", "text") == [(1, 0, "a"), (1, 1, "c"), (2, 0, "b")]
    cleared = G.clear_conversations(log, spark.createDataFrame([(1,)], "conv_id long"))
    assert rows(G.open_log(spark, G.rewrite_log(cleared)), "text") == [("b",)]
    assert log.count() == 3


# --- plans ----------------------------------------------------------------


def test_no_plan_pairs_all_rows(spark, asked, inputs, monkeypatch):
    """No step, staged ones included, is a cross or nested-loop join."""
    from harvestline import session
    from harvestline.operators import nearest as N

    plans = []

    def spy(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return session.stage(df, name)

    monkeypatch.setattr(P, "stage", spy)
    monkeypatch.setattr(N, "stage", spy)
    answered = A.answer_questions(asked, **inputs)
    cells = N.retrieve_by_cells(inputs["vectors"], inputs["index"], 1)
    for name, df in (("answers", answered), ("cells", cells)):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
    assert len(plans) > 8
    for name, plan in plans:
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_shared_folder_follows_the_session():
    def session(master, folder=None):
        context = SimpleNamespace(master=master, applicationId=master)
        conf = SimpleNamespace(get=lambda key, default: folder if key == CHECKPOINT_CONF else default)
        return SimpleNamespace(conf=conf, sparkContext=context)

    named = new_folder(session("yarn", "hdfs://x/shared/"), "t")
    assert named.startswith("hdfs://x/shared/harvestline/t-")
    local = session("local[2]")
    assert shared_folder(local).startswith("/tmp/run-")
    assert shared_folder(local) == shared_folder(local)
    with pytest.raises(ValueError, match=CHECKPOINT_CONF):
        shared_folder(session("yarn"))
