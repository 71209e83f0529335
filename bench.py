"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from diamondlake.plans import catalog
from diamondlake.session import build_session

HEADLINE = [
    "pitcher_rates", "team_batting_form", "pitcher_stuff_form", "lineups", "bullpen_load",
    "game_features", "pitch_features", "asof_lines", "rolling_mean", "records_entering",
    "elo_entering", "pooled_metrics", "daily_calibration", "feature_drift", "upsert_top_up",
    "fold_table",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", cpus, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").count()  # start-up is not measured
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings,
                      "sf": float(sf.group(1)) if sf else None, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
