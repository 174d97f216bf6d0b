"""Seconds per headline query: warm, median of three, and of training the summed families; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import statistics
import time

from augury.ml import models
from augury.plans import catalog, training
from augury.session import build_session, release

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "wallet_stats", "market_overview", "timeline_day", "dataset_stats", "cleaned_trades", "resolution_labels",
    "feature_matrix", "temporal_split", "composite_labels", "asof_prices", "event_study", "event_study_summary",
    "copy_metrics", "classification_metrics",
]


def seconds(run) -> float:
    started = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        {
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINE:
        run = lambda name=name: catalog.QUERIES[name](spark, SF_DIR)
        seconds(run)
        timings[name] = round(statistics.median(seconds(run) for _ in range(3)), 3)
        release(spark)
    total = round(sum(timings.values()), 3)  # of the queries alone, to compare with earlier rounds
    rows = catalog.model_rows(spark, SF_DIR)
    ready = training.prepare(rows)
    for name in catalog.SUMMED:  # search and calibration of a family, as one training run does them; forests once, cold
        fit = lambda name=name: training.train_family(ready, name, models.CANDIDATES[name], detailed_cv=False).predictions
        timings["train_" + name.lower().replace(" ", "_")] = round(min(seconds(fit) for _ in range(1 if models.CANDIDATES[name].score_many else 2)), 3)
    release(spark)
    print(
        json.dumps(
            {
                "metric": "total warm seconds of the headline queries",
                "value": total,
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
