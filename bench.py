"""Headline queries, warm, on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query is timed to the last row of its result (a no-op write), after one untimed run of the
track on the same session. The cache is cleared before each query, so every time includes the way
from the stored tables. Keys with ``_fine`` run on brand x type series instead of brand series, those
with ``_part`` on the parts themselves, whose number grows with the data.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from demandspark import queries as q  # noqa: E402
from demandspark.operators import ets, naive  # noqa: E402
from demandspark.plans import evaluate, scoring  # noqa: E402


def ets_fine(spark, sf):
    panel = q.fresh(spark, sf, "brand_type")
    return evaluate.evaluate_ets(panel, q.fresh_folds(panel), q.FRESH.horizon, q.FRESH.season_length)


def drift_fine(spark, sf):
    """All series of the panel, scored in batch for every known id."""
    panel = q.fresh(spark, sf, "brand_type")
    requests = panel.select("id").distinct().selectExpr("id", "4 AS horizon")
    return scoring.score_batch(requests, naive.drift(panel, q.FRESH.horizon))


def ets_forecast_fine(spark, sf):
    return ets.ets(q.fresh(spark, sf, "brand_type"), q.FRESH.horizon, q.FRESH.season_length)


QUERIES = {
    "track_fresh_weekly": q.track_fresh_weekly,
    "track_fresh_weekly_fine": q.track_fresh_weekly_fine,
    "track_fresh_weekly_part": q.track_fresh_weekly_part,
    "track_dry_monthly": q.track_dry_monthly,
    "eda_event_type_lift": q.eda_event_type_lift,
    "stockout_by_series": q.stockout_by_series,
    "promo_flags": q.promo_flags,
    "feature_matrix": q.feature_matrix,
    "feature_matrix_fine": q.feature_matrix_fine,
    "feature_matrix_part": q.feature_matrix_part,
    "eval_all_naive": q.eval_all_naive,
    "eval_all_naive_fine": q.eval_all_naive_fine,
    "eval_all_naive_part": q.eval_all_naive_part,
    "eval_ets": q.eval_ets,
    "eval_ets_fine": ets_fine,
    "fc_ets_fine": ets_forecast_fine,
    "score_batch": q.score_batch,
    "score_batch_fine": drift_fine,
    "score_batch_part": q.score_batch_part,
    "fc_gbt_l2": q.fc_gbt_l2,
    "fc_tweedie_corrected": q.fc_tweedie_corrected,
}


def run(spark, fn, sf) -> float:
    spark.catalog.clearCache()
    t0 = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("demandspark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, q.track_fresh_weekly, sf)
    times = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        times[name] = round(run(spark, fn, sf), 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf).name,
                "cores": int(cpus),
                "spark": spark.version,
                "shuffle_partitions": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
