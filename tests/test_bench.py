"""bench.py keeps the driver's output contract: one JSON line with metric,
value, unit, queries and sf (run as its own process on the smallest data)."""

import json
import os
import subprocess
import sys

from conftest import ROOT


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_RUNS="1", BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, cwd=ROOT,
                         capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    result = json.loads(lines[0])
    assert result["unit"] == "sec" and result["sf"] == "0.001"
    assert result["metric"] and result["value"] > 0
    assert {"enriched_build", "order_trend_stored", "detail_page_deep", "category_report", "top_stock", "latest_report"} <= set(result["queries"])
    assert all(v > 0 for v in result["queries"].values())
