"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``ingest`` is the one write of the stored tables all other queries scan. Every query is run to the
end into the no-op sink, without moving rows to Python.
"""

from __future__ import annotations

import json
import os
import sys
import time

from moundworks.fixtures import models as open_models
from moundworks.registry import queries
from moundworks.session import local_session

HEADLINE = [
    "season_era_fip_plus", "player_map_dedup", "whiff_plus", "contact_plus", "strike_plus",
    "ball_plus", "chase_plus", "pitch_grade_plus", "pitch_profile_usage", "pitch_physics_features",
    "stuff_target", "stuff_plus", "pitch_level_model", "nastiness_plus", "nastiness_top200",
    "win_expectancy", "run_expectancy", "wpa", "clutch_score", "approach_angles", "arsenal_features_of_targets",
    "arsenal_plus", "entry_state", "relief_run_prevention_plus", "pitcher_level_model",
]


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.range(1000).selectExpr("sum(id)").collect()

    def ingest() -> None:
        models = open_models(spark, sf_dir)
        for table in (models.pitches, models.players, models.seasons):
            table()

    registered = queries()
    names = sys.argv[1:] or HEADLINE
    times = {"ingest": timed(ingest)}
    for name in names:
        times[name] = timed(lambda: registered[name](spark, sf_dir)
                            .write.format("noop").mode("overwrite").save())
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds over headline queries", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
