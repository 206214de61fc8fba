"""How plan modules register a query together with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.tables import drop_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The driver's tables by name: ``t.orders`` reads ``orders.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def forget(self, name: str) -> None:
        """Drop a table of an earlier run, and its folder, which outlives a session whose catalog is in memory."""
        drop_table(self.spark, name)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.spark.catalog.getDatabase(self.spark.catalog.currentDatabase()).locationUri}/{name}")
        place.getFileSystem(conf).delete(place, True)

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the tables that ``text`` names as ``{orders}``."""
        used = {n: getattr(self, n) for n in TABLES if "{" + n + "}" in text}
        return self.spark.sql(text, **used)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def both(self, name: str, text: str, oracle: str | None = None) -> None:
        """Register Spark SQL that names tables as ``{orders}``; the oracle runs the same text unless it gets its own."""
        self.queries[name] = lambda spark, sf_dir: Tables(spark, sf_dir).sql(text)
        self.sql[name] = oracle or text.replace("{", "").replace("}", "")

    def add(self, sql: str | None = None, name: str | None = None):
        """Register ``f(t: Tables) -> DataFrame`` under its name, with the oracle's SQL if there is any."""

        def wrap(f):
            key = name or f.__name__
            self.queries[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql is not None:
                self.sql[key] = sql
            return f

        return wrap
