"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query's plan is run to completion with the ``noop`` sink (all rows are
produced, none is shipped to the driver). The layers that queries share
(Bronze, Silver, Gold tables, the forest) are built first and timed under
their own names, ``layer:<binding>:<layer>``, so a query's time is its own. Shuffles start at one partition per core (AQE coalesces from there;
at this input size more only adds task overhead). Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_QUERIES (comma-separated subset), BENCH_SHUFFLE_PARTITIONS.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from delaymart.plans.mart import DelayMart  # noqa: E402
from delaymart.plans.queries import HISTORY, QUERIES  # noqa: E402
from delaymart.session import build_session  # noqa: E402
from delaymart.sources.fixtures import BINDINGS  # noqa: E402

LAYERS = {
    "warm_up": lambda m: m.spark.range(1).write.format("noop").mode("overwrite").save(),
    "bronze": lambda m: m.bronze_path(),
    "silver": lambda m: m.silver_path(),
    "causes": lambda m: m.causes(),
    "anomalies": lambda m: m.anomalies(),
    "split": lambda m: m.split(),
    "stub_validation": lambda m: m.stub_validation_daily(),
    "stub_forecast": lambda m: m.stub_forecast_daily(),
    "forest": lambda m: m.forest_path(),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else list(QUERIES)
    spark = build_session(f"local[{cpus}]", app="delaymart-bench",
                          shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)),
                          extra={"spark.driver.memory": "16g"})
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    t_all = time.time()
    layers = {f"layer:{b}:{n}": (lambda b=b, n=n: LAYERS[n](DelayMart.of(spark, sf_dir, history=HISTORY, binding=b)))
              for b in BINDINGS for n in LAYERS if b == "segments" or n != "forest"}
    for name, build in ({} if only else layers).items():
        t0 = time.time()
        build()
        times[name] = round(time.time() - t0, 3)
    for name in names:
        t0 = time.time()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    total = round(time.time() - t_all, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": total, "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
           "cpus": cpus, "n_queries": len(times)}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
