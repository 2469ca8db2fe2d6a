"""Times of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from raywalk.params import Params  # noqa: E402
from raywalk.plans import pipeline, queries  # noqa: E402
from raywalk.session import local_session  # noqa: E402


SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
NAMES = ["conv_sum", "intersections", "density_grid", "edges", "running_mean", "cluster_util", "transfer_curves", "idle_busy", "anomaly_scores"]


def main() -> None:
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "16g")
    spark.sparkContext.setLogLevel("ERROR")
    found = {}

    def timed(name, f):
        times = []
        for _ in range(2):  # the first run also compiles
            start = time.time()
            f()
            times.append(time.time() - start)
            spark.catalog.clearCache()
        found[name] = round(min(times), 3)

    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    for name in NAMES:
        timed(name, lambda: sink(queries.queries()[name](spark, SF)))
    steps: dict[str, float] = {}
    detector = None

    def fitted():
        nonlocal detector
        detector = pipeline.Detector(queries.raw(spark, SF), Params())
        steps["model"] = detector.fit()

    timed("fit", fitted)
    timed("score", lambda: sink(detector.score(steps["model"])))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": Path(SF).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
