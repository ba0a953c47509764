"""Summarize a Spark event log: job and stage wall times.

Write the log to a scratch folder, e.g.
    build_session(..., extra={"spark.eventLog.enabled": "true",
                              "spark.eventLog.dir": "/tmp/run-XXXX"})
then: python tools/eventlog.py /tmp/run-XXXX [top_n]
Job groups set with ``sparkContext.setJobGroup`` are totalled separately.
"""

from __future__ import annotations

import collections
import glob
import io
import json
import os
import sys


def _lines(path: str):
    with open(path, "rb") as fh:
        if path.endswith(".zstd"):
            import zstandard
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh),
                                        encoding="utf-8")
        else:
            yield from io.TextIOWrapper(fh, encoding="utf-8")


def main() -> None:
    folder = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    files = [f for f in glob.glob(os.path.join(folder, "**", "*"), recursive=True)
             if os.path.isfile(f) and "events" in os.path.basename(f)
             or os.path.isfile(f) and os.path.basename(f).startswith(("local-", "app-"))]
    jobs, stages = {}, {}
    for f in files:
        for line in _lines(f):
            e = json.loads(line)
            ev = e.get("Event")
            if ev == "SparkListenerJobStart":
                group = e.get("Properties", {}).get("spark.jobGroup.id")
                jobs[e["Job ID"]] = [e["Submission Time"], None, group]
            elif ev == "SparkListenerJobEnd" and e["Job ID"] in jobs:
                jobs[e["Job ID"]][1] = e["Completion Time"]
            elif ev == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                if "Submission Time" in si and "Completion Time" in si:
                    stages[si["Stage ID"]] = ((si["Completion Time"] - si["Submission Time"]) / 1000,
                                              si["Stage Name"][:70], si["Number of Tasks"])
    per_group = collections.defaultdict(lambda: [0, 0.0])
    for start, end, group in jobs.values():
        if end:
            per_group[group][0] += 1
            per_group[group][1] += (end - start) / 1000
    for group, (n, sec) in sorted(per_group.items(), key=lambda x: -x[1][1]):
        print(f"group {group}: {n} jobs, {sec:.2f} s")
    for sid, (sec, name, tasks) in sorted(stages.items(), key=lambda x: -x[1][0])[:top]:
        print(f"stage {sid}: {sec:.2f} s, {tasks} tasks, {name}")


if __name__ == "__main__":
    main()
