"""Summarise a Spark event log folder: wall time per job and per stage.

usage: python tools/eventlog_summary.py EVENT_LOG_DIR [--top N]

Reads plain or zstd-compressed event files (``spark.eventLog.dir``), so stage
and task times can be inspected without the web UI.
"""

from __future__ import annotations

import argparse
import glob
import io
import json
import os


def _lines(path: str):
    if path.endswith(".zstd") or path.endswith(".zst"):
        import zstandard
        with open(path, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("folder")
    ap.add_argument("--top", type=int, default=30)
    args = ap.parse_args()
    files = [f for f in glob.glob(os.path.join(args.folder, "**", "*"), recursive=True)
             if os.path.isfile(f) and "appstatus" not in os.path.basename(f)]
    jobs, stages, tasks = {}, {}, {}
    for f in sorted(files):
        for line in _lines(f):
            e = json.loads(line)
            ev = e.get("Event")
            if ev == "SparkListenerJobStart":
                jobs[e["Job ID"]] = [e["Submission Time"], None, [s["Stage ID"] for s in e["Stage Infos"]]]
            elif ev == "SparkListenerJobEnd" and e["Job ID"] in jobs:
                jobs[e["Job ID"]][1] = e["Completion Time"]
            elif ev == "SparkListenerTaskEnd":
                ti = e["Task Info"]
                tasks.setdefault(e["Stage ID"], []).append(ti["Finish Time"] - ti["Launch Time"])
            elif ev == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                if si.get("Submission Time") and si.get("Completion Time"):
                    stages[si["Stage ID"]] = (si["Completion Time"] - si["Submission Time"], si["Number of Tasks"],
                                              si["Stage Name"][:70])
    total = sum((b - a) for a, b, _ in jobs.values() if b)
    print(f"{len(jobs)} jobs, {len(stages)} stages run, job wall sum {total} ms")
    for j, (a, b, st) in sorted(jobs.items()):
        print(f"job {j:4d} {((b - a) if b else -1):7d} ms  stages {st}")
    print("slowest stages:")
    for sid, (ms, n, name) in sorted(stages.items(), key=lambda x: -x[1][0])[:args.top]:
        ts = sorted(tasks.get(sid, [0]))
        print(f"stage {sid:4d} {ms:7d} ms {n:4d} tasks (task ms median {ts[len(ts) // 2]}, max {ts[-1]})  {name}")


if __name__ == "__main__":
    main()
