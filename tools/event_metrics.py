"""Per-job-group I/O totals from a Spark event log (read after the session
stops, so the log is complete).

For every job group: bytes read by scans, shuffle bytes written, records
read, and task count, summed over the tasks of all stages of its jobs
(broadcast and subquery jobs inherit the group of the query that started
them).
"""

from __future__ import annotations

import glob
import json
import os
from collections import defaultdict


def group_metrics(event_dir: str) -> dict[str, dict[str, float]]:
    stage_group: dict[int, str] = {}
    totals: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    paths = sorted(p for p in glob.glob(os.path.join(event_dir, "**", "*"), recursive=True)
                   if os.path.isfile(p) and not os.path.basename(p).startswith("appstatus"))
    for path in paths:
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    if group:
                        for sid in ev.get("Stage IDs", []):
                            stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    group = stage_group.get(ev.get("Stage ID"))
                    m = ev.get("Task Metrics") or {}
                    if not group or not m:
                        continue
                    t = totals[group]
                    t["tasks"] += 1
                    t["input_bytes"] += (m.get("Input Metrics") or {}).get("Bytes Read", 0)
                    t["input_records"] += (m.get("Input Metrics") or {}).get("Records Read", 0)
                    t["shuffle_write_bytes"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
    return {g: dict(v) for g, v in totals.items()}
