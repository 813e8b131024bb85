"""Stored posts in buckets of their key, merged by touched buckets only.

A merge reads and writes the buckets that its envelopes touch. It never
overwrites what is being read: a version's rows go to a folder of their own,
and a small head table (one row for each bucket) says which version holds each
bucket. The head is one file, written last, so a merge that broke off leaves
the store as it was, and repeating a version starts from the one before it.
A merge first removes the rows that the version before it does not hold: only
two versions are on disk at once. Large merges go through the buckets in
rounds, so only a share of the posts is shuffled at once.
"""

from __future__ import annotations

from contextlib import ExitStack
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from corroborate.functions.text import trim_spaces
from corroborate.operators.blocks import join_few, previous_value
from corroborate.operators.posts import KEY, upsert_raw_posts
from corroborate.session import cut_lineage, folders, released_shuffles, remove, stored_meanwhile, table_bytes

#: Rounds in which a merge goes through its buckets, at most.
SHARES = 8
#: Bytes of files that are merged in one round, unless the rounds are used up.
ROUND_BYTES = 128 << 20
#: Set where a row's clean text is its trimmed text: most are, and are written once.
TRIMMED = "_trimmed"


@dataclass(frozen=True)
class PostStore:
    """Posts of ``schema`` under ``path``, a folder that all executors reach."""

    path: str
    schema: StructType
    buckets: int = 64

    def bucket(self):
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def heads(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """The version of each bucket, as it was before a version; at most one row for each bucket is collected."""
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/heads")
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return {}
        known = spark.read.schema("bucket int, holds int, version int").parquet(f"{self.path}/heads")
        if before is not None:
            known = known.filter(F.col("version") < before)
        last = known.agg(F.max("version")).first()[0]
        return {r["bucket"]: r["holds"] for r in known.filter(F.col("version") == last).collect()} if last is not None else {}

    def read(self, spark: SparkSession, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """Stored posts, all or those of some buckets; the folders of other buckets are not opened."""
        held = {b: v for b, v in self.heads(spark, before).items() if buckets is None or b in buckets}
        found = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in sorted(held.items())]
        if not found:
            return spark.createDataFrame([], self.schema)
        rows = spark.read.schema(StructType([*self.schema.fields, StructField(TRIMMED, BooleanType())])).parquet(*found)
        clean = F.when(F.col(TRIMMED), trim_spaces(F.col("original_text"))).otherwise(F.col("normalized_text"))
        return rows.withColumn("normalized_text", clean).select(*self.schema.names)

    def write(self, posts: DataFrame, version: int) -> None:
        """Rows added to a version's buckets; they count once the head says so."""
        placed = posts.select(*self.schema.names, self.bucket().alias("bucket")).repartition("bucket")
        trimmed = F.col("normalized_text").eqNullSafe(trim_spaces(F.col("original_text")))
        placed = placed.withColumn(TRIMMED, trimmed).withColumn("normalized_text", F.when(~F.col(TRIMMED), F.col("normalized_text")))
        with released_shuffles(posts.sparkSession):
            placed.write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/rows/version={version}")

    def head(self, spark: SparkSession, version: int, holds: dict[int, int]) -> None:
        frame = spark.createDataFrame(sorted(holds.items()), "bucket int, holds int")
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/heads/version={version}")

    def forget(self, spark: SparkSession, before: int | None = None) -> None:
        """Remove what the store does not hold: rows of older versions, and all of those from ``before`` on.

        Nothing may read the removed versions any more.
        """
        held = {(v, b) for b, v in self.heads(spark, before).items()}
        heads = sorted(int(name.split("=")[1]) for name in folders(spark, f"{self.path}/heads") if "=" in name)
        last = max((h for h in heads if before is None or h < before), default=None)
        for version in reversed(heads):  # a head goes before the rows it names
            if version != last:
                remove(spark, f"{self.path}/heads/version={version}")
        for version in folders(spark, f"{self.path}/rows"):
            rows = f"{self.path}/rows/{version}"
            kept = {f"bucket={b}" for v, b in held if version == f"version={v}"}
            for bucket in folders(spark, rows) if kept else []:
                if bucket not in kept:
                    remove(spark, f"{rows}/{bucket}")
            if not kept:
                remove(spark, rows)

    def create(self, posts: DataFrame) -> PostStore:
        spark = posts.sparkSession
        self.forget(spark, 0)
        self.write(posts, 0)
        self.head(spark, 0, {int(name.split("=")[1]): 0 for name in folders(spark, f"{self.path}/rows/version=0") if "=" in name})
        return self

    def merge(self, envelopes: DataFrame, version: int, changed_only: bool = False) -> None:
        """The envelope log (``seq`` in order of arrival) merged into the posts of its own buckets.

        With ``changed_only`` an envelope counts only if its fingerprint differs
        from the one before it, or from the stored one. Running a version again replaces it.
        """
        spark = envelopes.sparkSession
        self.forget(spark, version)
        before = self.heads(spark, version)
        placed = envelopes.withColumns({"bucket": self.bucket(), "_row": F.monotonically_increasing_id()})
        with ExitStack() as after:
            with stored_meanwhile(placed) as landed:
                same = cut_lineage(unchanged(self.read(spark, self._touched(landed), version), landed)) if changed_only else None
                if same is None or same.isEmpty():
                    self._merge(landed, version, before)
                    return
                changed = after.enter_context(stored_meanwhile(join_few(landed, same, "_row", "left_anti")))
            self._merge(changed, version, before)  # what landed is gone by now

    def _touched(self, placed: DataFrame) -> list[int]:
        return sorted(r["bucket"] for r in placed.select("bucket").distinct().collect())

    def _merge(self, placed: DataFrame, version: int, before: dict[int, int]) -> None:
        spark, touched = placed.sparkSession, self._touched(placed)
        size = table_bytes(placed) + table_bytes(self.read(spark, touched, version))
        shares = min(SHARES, max(1, len(touched)), 1 + size // ROUND_BYTES)
        for share in range(shares):
            own = touched[share::shares]
            rows = placed.filter(F.col("bucket").isin(own)).drop("bucket", "_row")
            self.write(upsert_raw_posts(self.read(spark, own, version), rows), version)
        if touched:
            self.head(spark, version, {**before, **dict.fromkeys(touched, version)})


def unchanged(current: DataFrame, placed: DataFrame) -> DataFrame:
    """B2: ``_row`` of envelopes whose fingerprint is that of the envelope before, the first ones' that of the stored post.

    Only keys and fingerprints are moved for that, no texts.
    """
    rows = placed.select(*KEY, "seq", "content_hash", "_row")
    rows = previous_value(rows, KEY, ["seq", "_row"], F.floor(F.col("seq") / 60_000_000), F.col("content_hash"), "_before")
    stored = current.select(*KEY, F.col("content_hash").alias("_stored"))
    rows = rows.join(stored, KEY, "left")
    return rows.filter(F.col("content_hash").eqNullSafe(F.coalesce("_before", "_stored"))).select("_row")
