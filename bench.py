"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query's full plan is executed into Spark's ``noop`` sink (no collect),
after a warm-up with two queries to start the JVM and code paths. The model
comparison is left out: it fits six models and takes minutes.
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "match_pairs", "extract_skills", "clean_text", "curate_dataset", "drop_funnel",
    "tfidf", "nb_predict", "stratified_split", "eval_metrics",
    "history_page", "feedback_upsert", "register_dedup",
    "cache_flags", "rate_limit", "confidence_histogram",
    "rank_candidates", "rate_limit_stream", "predict_stream", "match_stream", "train_category", "score_texts", "stream_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE

    from jobtext.plans import QUERIES
    from jobtext.session import build_session

    spark = build_session(cores=cpus, shuffle_partitions=max(2 * cpus, 8), app="jobtext-bench", read_partitions=cpus)
    for name in ("class_weights", "skill_match"):  # warm-up: JVM, readers, joins and the skill expressions
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]} s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
