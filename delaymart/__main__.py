"""Command line: run the steps over a raw CSV tree or the given tables.

    python -m delaymart --bronze /data/bronze --out /data/mart --entity EDDF \\
        --history 2022-2025 --target-year 2026
    python -m delaymart --tables /root/testdata/sf0.01 --out /tmp/mart \\
        --steps etl,eda,anomalies
"""

from __future__ import annotations

import argparse
import json

from delaymart.plans.jobs import STEPS, run_steps
from delaymart.plans.mart import DelayMart
from delaymart.session import apply_scale_settings, build_session
from delaymart.sinks.manifest import files_mark


def main(argv=None) -> dict[str, str]:
    ap = argparse.ArgumentParser(prog="delaymart")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--bronze", help="raw CSV tree (header, any depth)")
    src.add_argument("--tables", help="folder of the given Parquet tables")
    ap.add_argument("--out", required=True, help="folder for silver/, gold/, model/, report/")
    ap.add_argument("--entity", default=None, help="train the forest on this code only (default: all)")
    ap.add_argument("--entities", default=None,
                    help="comma-separated codes to keep in Silver (default: all)")
    ap.add_argument("--history", default=None, help="forecast history years, A-B (default: the last four)")
    ap.add_argument("--target-year", type=int, default=2026)
    ap.add_argument("--trees", type=int, default=None)
    ap.add_argument("--steps", default=",".join(STEPS))
    ap.add_argument("--fit-partitions", type=int, default=4, help="tasks of the forest's fit")
    ap.add_argument("--leak-free", action="store_true", help="train on calendar features only")
    ap.add_argument("--master", default=None)
    ap.add_argument("--rebuild", action="store_true",
                    help="rebuild every layer (default: the named steps', and upstream ones whose "
                         "manifest does not match the input and parameters)")
    a = ap.parse_args(argv)
    spark = build_session(a.master)
    apply_scale_settings(spark, files_mark(spark, a.tables or a.bronze)[1])
    history = tuple(int(x) for x in a.history.split("-")) if a.history else None
    kw = {"num_trees": a.trees} if a.trees else {}
    m = DelayMart(spark, sf_dir=a.tables, bronze_dir=a.bronze, entity=a.entity,
                  entities=a.entities.split(",") if a.entities else None,
                  history=history, target_year=a.target_year, root=a.out,
                  reuse=not a.rebuild, fit_partitions=a.fit_partitions, leak_free=a.leak_free, **kw)
    out = run_steps(m, [s for s in a.steps.split(",") if s])
    print(json.dumps(out, indent=1))
    return out


if __name__ == "__main__":
    main()
