"""EXPLAIN: plans as text or as JSON, with what the run measured if it is asked for."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame


def explain(df: DataFrame, analyze: bool = False, format: str = "text", mode: str = "formatted") -> str:
    """The plan of a query. analyze: run it and add its seconds and rows. format: "text" or "json"."""
    if format not in ("text", "json"):
        raise ValueError(f"unknown EXPLAIN format: {format}")
    execution = df._jdf.queryExecution()
    measured = {}
    if analyze:
        began = time.perf_counter()
        measured["rows"] = df.count()
        measured["seconds"] = round(time.perf_counter() - began, 6)
    if format == "json":
        return json.dumps({"plan": json.loads(execution.optimizedPlan().toJSON()), "physical": execution.executedPlan().toString(), **measured})
    text = execution.explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
    return text + "".join(f"\n{k}: {v}" for k, v in measured.items())
