"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from lexmill.plans import load_all
from lexmill.session import build_session

HEADLINE = ["fact_mentions", "label_clause_type", "risk_document_scores", "stat_gini", "stat_thresholds", "cut_sections",
            "conflict_numeric", "conflict_dates", "graph_dependencies", "trust_index", "search_nearest_scores",
            "report_document_metrics", "compare_numbered", "text_token_groups"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", app="bench", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)) if cpus.isdigit() else "16", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    queries = load_all().QUERIES
    spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey").count().write.format("noop").mode("overwrite").save()
    # Python workers start once per session; their start is no query's work.
    spark.range(64).repartition(int(cpus) if cpus.isdigit() else 8).mapInPandas(lambda batches: batches, "id long").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    rows = {q: spark.read.parquet(f"{sf}/{t}.parquet").count() for q, t in (("risk_document_scores", "lineitem"), ("search_nearest_scores", "embeddings"))}
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf,
                      "rows_per_sec": {q: round(n / seconds[q]) for q, n in rows.items() if q in seconds}}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
