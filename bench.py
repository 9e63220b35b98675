"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexiloom.plans import queries  # noqa: E402
from lexiloom.session import build_session  # noqa: E402

HEADLINE = [
    "document_statistics", "clean_text", "keywords_local", "keywords_corpus", "section_tfidf", "search_topk",
    "search_corpus", "stratified_split", "vocabulary_topk", "train_classifier", "predict", "document_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "lexiloom-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
           # one machine only: stored tables may lie in a folder of its own
           "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="lexiloom-bench-")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries.tokenize_words(spark, folder).limit(1).collect()
    seconds, quality, model = {}, {}, None
    for name in HEADLINE:
        if name == "predict":  # the model it scores with is timed apart
            start = time.time()
            model = queries._share_model(spark, folder)
            seconds["predict_model"] = round(time.time() - start, 3)
        start = time.time()
        result = queries.classifier_predictions(spark, folder, model) if name == "predict" else getattr(queries, name)(spark, folder)
        if name == "train_classifier":
            quality = result.first().asDict()
        else:
            result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "accuracy": quality.get("accuracy"), "f1_macro": quality.get("f1_macro"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
