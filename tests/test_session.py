from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from millrace.functions import json as js
from millrace.session import session
spark = session("local[1]", spark__ui__enabled="false", spark__sql__shuffle__partitions="1")
rows = spark.createDataFrame([('{{"a": [1, {{"b": 2}}]}}',)], "j string")
print(rows.select(js.json_contains(F.col("j"), F.lit('{{"b":2}}')), js.json_structure(F.col("j")), js.json_minify(F.col("j"))).first()[:])
print(rows.agg(js.json_group_structure(F.col("j"))).first()[0])
"""


def test_workers_import_the_package_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.splitlines() == ["(True, '{\"a\":[\"JSON\"]}', '{\"a\":[1,{\"b\":2}]}')", '{"a":["JSON"]}'], done.stderr[-2000:]
