"""Follow chains of pointers to their ends by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.session import cut_lineage


def follow(pointers: DataFrame, scope: list[str], node: str, target: str) -> DataFrame:
    """Resolve ``node -> target`` rows to the last target of each chain.

    ``scope`` columns limit the chains (a batch, an event). Every round
    doubles the distance covered and is checkpointed, so a lost executor only
    costs the running round. Rows whose chain never ends keep
    ``ended = false``: once no further row ends, the rest are cycles.
    Returns scope, node, ``last`` and ``ended``.
    """
    base = pointers.select(*scope, F.col(node).alias("node"), F.col(target).alias("at")).distinct()
    nodes = base.select(*scope, F.col("node").alias("at")).distinct().withColumn("more", F.lit(True))
    state = cut_lineage(
        base.join(nodes, [*scope, "at"], "left")
        .select(*scope, "node", "at", F.coalesce(~F.col("more"), F.lit(True)).alias("ended"))
    )
    open_rows = state.filter("not ended").count()
    while open_rows:
        step = state.select(
            *scope, F.col("node").alias("at"), F.col("at").alias("next"), F.col("ended").alias("next_ended")
        )
        moved = (
            state.filter("not ended")
            .join(step, [*scope, "at"])
            .select(*scope, "node", F.col("next").alias("at"), F.col("next_ended").alias("ended"))
        )
        state = cut_lineage(state.filter("ended").unionByName(moved))
        left = state.filter("not ended").count()
        if left == open_rows:
            break
        open_rows = left
    return state.select(*scope, F.col("node").alias(node), F.col("at").alias("last"), "ended")
