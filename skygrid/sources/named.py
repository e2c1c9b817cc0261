"""Tables by name: replaced as a whole, attached read-only, listed; and writes that hold expectations."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skygrid.sources.scratch import shared_dir


class ExpectationError(ValueError):
    """A write's rows do not hold what was expected; nothing was replaced."""


def temp_rows(spark: SparkSession, name: str, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A session view of rows that the driver holds, in place of one of that name."""
    df = spark.createDataFrame(list(rows), schema)
    df.createOrReplaceTempView(name)
    return df


def versions(spark: SparkSession, name: str) -> list[str]:
    """Stored versions of a named table, the oldest first."""
    database, _, plain = name.rpartition(".")
    found = spark.sql(f"SHOW TABLES IN {database or spark.catalog.currentDatabase()} LIKE '{plain}__v*'").collect()
    return sorted(f"{r.namespace}.{r.tableName}" for r in found)


def replace_table(df: DataFrame, name: str, expect: dict[str, tuple[Column, Callable[[Column], Column]]] | None = None, kept: int = 2) -> dict[str, object]:
    """Write df as the next version of a named table and let the name show it; the metrics of ``expect``.

    The rows go to a table of their own first. The name is a view that is swapped when they are whole, so
    readers see the old rows until then, and a write that fails leaves them. The last ``kept`` versions stay for
    those who still read them. ``expect`` maps a rule's name to a metric (an aggregate) and a condition on
    it; all metrics are observed in the pass that writes. If a condition does not
    hold, the new version is dropped and an error names the rule and the metric.
    """
    spark = df.sparkSession
    database, _, plain = name.rpartition(".")
    database = database or spark.catalog.currentDatabase()
    old = versions(spark, f"{database}.{plain}")
    number = int(old[-1].rpartition("__v")[2]) + 1 if old else 1
    new, watch = f"{database}.{plain}__v{number:08d}", Observation()
    rules = expect or {}
    seen = df.observe(watch, *(metric.alias(k) for k, (metric, _) in rules.items())) if rules else df
    try:
        seen.write.option("path", f"{shared_dir(spark)}/named/{plain}-{uuid.uuid4().hex}").saveAsTable(new)
        values = watch.get if rules else {}
        failed = _failed(spark, rules, values)
        if failed:
            raise ExpectationError(failed)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {new}")
        raise
    spark.sql(f"CREATE OR REPLACE VIEW {database}.{plain} AS SELECT * FROM {new}")
    for table in [*old, new][: -max(kept, 1)]:
        spark.sql(f"DROP TABLE {table}")
    return values


def _failed(spark: SparkSession, rules: dict, values: dict) -> str:
    """Rules whose condition is not true, with their metrics. A row of constants, no job on the data."""
    if not rules:
        return ""
    one = spark.range(1)
    checks = one.select(*(c(F.lit(values[k])).alias(k) for k, (_, c) in rules.items())).first()
    return "; ".join(f"{k}: {values[k]}" for k in rules if checks[k] is not True)


def attach(spark: SparkSession, folder: str, database: str, names: Iterable[str]) -> None:
    """Show the Parquet tables of a folder as views of a database: readable by name, and not to be written."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in names:
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS SELECT * FROM parquet.`{folder}/{name}.parquet`")


def listing(spark: SparkSession, database: str) -> DataFrame:
    """(table, column, kind, position) of all names of a database but stored versions."""
    rows = []
    for t in spark.catalog.listTables(database):
        if "__v" not in t.name and not t.isTemporary:
            rows += [(t.name, c.name, c.dataType, i) for i, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}"))]
    return spark.createDataFrame(rows, "table string, column string, kind string, position int")
