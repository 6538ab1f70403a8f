"""Time the headline queries and print one JSON line.

Each query runs once to warm up, then up to BENCH_ROUNDS times within about
BENCH_SECONDS; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from harvestline.session import local_session  # noqa: E402
from querybook import book  # noqa: E402

HEADLINES = [
    "price_stats", "price_stats_events", "price_series_location", "price_avg_location",
    "price_ma7", "price_records", "price_location_fallback", "load_csv_table",
    "lang_priority", "intent_keywords_docs", "intent_rules_join", "entities",
    "entities_gazetteer_join", "doc_chunks", "index_join", "knn_topk", "knn_cells",
    "rag_prompt", "answer_batch", "answer_stream", "conversation_replay",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    rounds = int(os.environ.get("BENCH_ROUNDS", "3"))
    budget = float(os.environ.get("BENCH_SECONDS", "8"))
    wanted = sys.argv[1:] or HEADLINES
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    registered = book()

    def once(name: str) -> float:
        started = time.perf_counter()
        registered[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    times: dict[str, float] = {}
    for name in wanted:
        once(name)  # warm-up
        taken: list[float] = []
        while len(taken) < rounds and sum(taken) < budget:
            taken.append(once(name))
        times[name] = round(statistics.median(taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_median_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cores": cores,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                "rounds": rounds,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
