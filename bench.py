"""Run the headline queries and print one JSON line with their times."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textscore import catalog
from textscore.session import session

HEADLINES = (
    "score_filter_key", "speech_speaker_right_join", "score_left_join_fanout", "latest_per_key",
    "first_per_key", "airing_percentile_filter", "airing_time_buckets", "airings_end_to_end",
    "tokenize", "token_stats", "lemma_lookup", "speaker_first_values", "speaker_aggregate",
    "ngrams", "vocab_fit", "max_features", "tfidf_transform", "vocab_grid", "folds",
    "cv_metrics", "gram_matrix", "ridge_search", "search_report", "ridge_embeddings",
    "score_documents",
)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
        "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up of the session and of the Python workers is not part of a query.
    spark.range(1000).selectExpr("sum(id)").collect()
    runs, times, errors = catalog.queries(), {}, {}
    for name in HEADLINES:
        started = time.perf_counter()
        try:
            runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
        except Exception as error:  # one query's failure must not lose the others' times
            times[name], errors[name] = None, f"{type(error).__name__}: {error}"[:300]
    done = [t for t in times.values() if t is not None]
    print(json.dumps({"metric": "total time of headline queries",
                      "value": round(sum(done), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      **({"errors": errors} if errors else {})}))
    return 1 if errors else 0


if __name__ == "__main__":
    sys.exit(main())
