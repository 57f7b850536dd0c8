"""Time the headline queries: one JSON line with seconds per query."""

import json
import os
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from pyspark.sql import SparkSession  # noqa: E402

from boutline import plans  # noqa: E402

HEADLINE = ["pregame_features", "form_log", "rest_density", "travel_and_zone_shift", "rolling_min_periods", "h2h_prior",
            "member_prior", "set_continuity", "pitcher_prior", "schedule_strength", "play_summary", "standings", "feature_base",
            "box_rates", "elo_season_carry", "elo_tuning", "strength", "model_scores", "reliability", "confidence_tiers", "roc_auc",
            "block_bootstrap", "regime_blend", "histogram_binning", "monotone_surface", "surface_scores", "bucket_gap",
            "snapshots", "stream_win_probability", "walk_forward_logistic"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "20g")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    plans.QUERIES["season_summary"](spark, folder).write.format("noop").mode("overwrite").save()
    names = [n for n in sys.argv[1:] if n in plans.QUERIES] or HEADLINE
    seconds = {}
    for name in names:
        start = time.time()
        plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_wall_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
