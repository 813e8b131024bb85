"""Insert-if-absent and overwrite-on-conflict sinks, and JSON diagnostics.

The sinks are pure: they return the new table, and running one twice with the
same rows gives the same table. Write the result with :func:`publish` to a new
folder; overwriting a folder that is still being read would lose it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.operators.blocks import first_per_key, last_per_key


def new_rows(target: DataFrame, rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """First row of each key that the target does not hold yet."""
    return first_per_key(rows, key, order).join(target.select(*key), key, "left_anti")


def append_new(target: DataFrame, rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Insert if absent."""
    fresh = new_rows(target, rows, key, order).select(*target.columns)
    return target.unionByName(fresh)


def upsert_latest(target: DataFrame, rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Overwrite on conflict; the row with the largest order wins."""
    return last_per_key(target.unionByName(rows.select(*target.columns)), key, order)


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a table as parquet; a rerun replaces its own output."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_diagnostics(failed: DataFrame, path: str) -> None:
    """Failed batches as JSON, one folder per window."""
    stamp = F.date_format("window_end", "yyyy-MM-dd'T'HH-mm")
    failed.withColumn("window", stamp).write.mode("overwrite").partitionBy("window").json(path)
