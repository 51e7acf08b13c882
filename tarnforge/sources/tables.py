"""Stages for uploads, scans of tables by name, and a connector for tables in a folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnforge.functions.lineage import remove
from tarnforge.sources.bronze import GuardError, identifier


def put_stage(df: DataFrame, root: str, run: str, table: str) -> str:
    """Writes rows as compressed CSV with a header to a folder of this run, over what it may hold."""
    path = f"{root.rstrip('/')}/_uploads/{run[:12]}/{table}"
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
    return path


def clear_stage(spark: SparkSession, root: str, run: str) -> bool:
    """Removes all uploads of a run."""
    return remove(spark, f"{root.rstrip('/')}/_uploads/{run[:12]}")


def scan(spark: SparkSession, name: str) -> DataFrame:
    """A table or view by its name of up to three parts, lazily. The name is checked before it is used."""
    return spark.table(identifier(name))


class Connector:
    """Reads tables of Parquet below a root: whole ones, or what a query needs of them."""

    def __init__(self, spark: SparkSession, root: str, suffix: str = ""):
        self.spark, self.root, self.suffix = spark, root.rstrip("/"), suffix

    def table(self, name: str, columns: list[str] | None = None) -> DataFrame:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
            raise GuardError(f"bad table name {name!r}")
        df = self.spark.read.parquet(f"{self.root}/{name}{self.suffix}")
        return df.select(*columns) if columns else df

    def query(self, sql: str, tables: list[str]) -> DataFrame:
        """One SELECT or WITH over ``{table}`` placeholders. Its filters and columns reach the scans, as
        the tables are views of this query alone."""
        text = sql.strip().rstrip(";").strip()
        if ";" in text or not re.match(r"(?is)^(select|with)\b", text):
            raise GuardError("a single SELECT or WITH is allowed")
        names = {}
        for t in tables:
            names[t] = f"_{t}_{uuid.uuid4().hex[:12]}"
            self.table(t).createOrReplaceTempView(names[t])
        try:
            return self.spark.sql(text.format(**names))
        finally:
            for n in names.values():  # the plan holds the relations, not the names
                self.spark.catalog.dropTempView(n)


def session(spark: SparkSession) -> DataFrame:
    """Where and as whom the session works."""
    return spark.range(1).select(F.current_catalog().alias("catalog"), F.current_schema().alias("schema"), F.current_user().alias("user"))
