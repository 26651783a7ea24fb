"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs $BENCH_RUNS times (3) and the median counts. A query is run to its end by
writing its rows to the no-op sink, so every column is computed and nothing is collected.
With BENCH_DUCKDB=1 the SQL text of the same queries is timed in DuckDB next to it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from devprism.registry import QUERIES  # noqa: E402
from devprism.session import local_session  # noqa: E402

HEADLINE = [
    "author_commit_features", "author_sentiment_features", "author_topic_features", "author_features",
    "commit_correlation", "standardized_features", "raw_commits", "answered_calls", "issue_comments",
    "comment_arrays", "reattributed_comments", "clean_documents", "vocabulary", "class_tfidf",
    "topic_similarity", "topic_top_terms", "reduced_outliers", "npmi_coherence", "cv_coherence",
    "topic_assignment", "classification_metrics", "sentiment_distribution", "silhouette", "pairs_within_radius",
    "core_flags", "density_core_counts", "nearest_authors", "density_clusters",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "16g"), "bench")
    timed = {}
    for name in names:
        seconds = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        timed[name] = round(median(seconds), 3)
        print(f"{name}: {timed[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "headline queries, total seconds",
        "value": round(sum(timed.values()), 3),
        "unit": "sec",
        "queries": timed,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if os.environ.get("BENCH_DUCKDB"):
        sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "tests"))
        from compare import connect

        db = connect(sf_dir)
        db.execute(f"SET threads = {cpus}")
        result["duckdb"] = {}
        for name in names:
            text = QUERIES[name].sql
            text = text() if callable(text) else text
            if text:
                start = time.perf_counter()
                db.execute(text).to_arrow_table()
                result["duckdb"][name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
