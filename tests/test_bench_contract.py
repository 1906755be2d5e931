"""bench.py prints one JSON line in the driver's format."""

from __future__ import annotations

import json
import os
import subprocess
import sys

from tests.conftest import ROOT, SMOKE_DIR


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SMOKE_DIR, BENCH_CPUS="2", BENCH_QUERIES="kpi_summary,top_products")
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True, text=True, timeout=600
    )
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    result = json.loads(lines[0])
    assert result["unit"] == "sec" and result["sf"] == 0.001
    assert set(result["queries"]) == {"kpi_summary", "top_products"}
    assert result["value"] == round(sum(result["queries"].values()), 3)
