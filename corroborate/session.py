"""Session set-up and lineage cuts."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corroborate

#: Bytes of files whose rows are one task's work.
PIECE_BYTES = 8 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on.

    Time zone UTC makes instants comparable with ISO text. Adaptive execution
    splits skewed joins and coalesces small shuffle partitions. The group
    limit threshold lets per-key quotas (up to 2,048) be pruned before the
    shuffle. The few Python functions travel by value, so executors need no
    copy of this package.
    """
    cloudpickle.register_pickle_by_value(corroborate)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "2048")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A session for tests and local benchmarks; ``shared`` is the folder of checkpoints."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corroborate")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
    )
    if shared is not None:
        builder = builder.config("spark.checkpoint.dir", shared).config("spark.sql.warehouse.dir", f"{shared}/warehouse")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors reach: ``spark.checkpoint.dir``, or one in the warehouse where it is unset.

    The warehouse is shared as well, so no node writes where others cannot read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        if not local and warehouse.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir: the warehouse is a local folder of the driver")
        folder = f"{warehouse}/_shared"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    with released_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared folder as a table: texts take far less room there than in a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with released_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def stored_meanwhile(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as ``stored``, for a step that needs it several times; the table is removed after the step."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    try:
        with released_shuffles(spark):
            df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of tables that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of what is in a folder, none if there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files of a table."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def files_stamp(spark: SparkSession, path: str) -> str:
    """A name for the present content of a path: places, sizes and times of its files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
    seen = []
    while found.hasNext():
        status = found.next()
        seen.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def plan_stamp(df: DataFrame) -> str:
    """A name for the rules that derive ``df``: its plan, without the numbers that change from run to run.

    The plan is taken as it was written: a canonical one orders the sides of sums and conditions by hashes
    of those numbers, so it differs between sessions, and a table would be derived again in each.
    """
    conf, limit = df.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    before = conf.get(limit)
    conf.set(limit, "100000")
    try:
        plan = df._jdf.queryExecution().analyzed().toString()
    finally:
        conf.set(limit, before)
    return hashlib.sha256(re.sub(r"#\d+L?|\b[xyz]_\d+\b", "", plan).encode()).hexdigest()


def derived_table(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the files at ``source``, written to the shared folder and scanned from there.

    Its place follows from the files and from the rules as they are now, so a
    change of either never gives an old answer. It is written under a name of
    its own and renamed when it is whole: of two writers the first one counts,
    and a table whose writing broke off is never read.
    """
    derived = build()
    stamp = hashlib.sha256(f"{files_stamp(spark, source)} {plan_stamp(derived)}".encode()).hexdigest()
    path = f"{shared_folder(spark)}/tables/{name}-{stamp}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        written = f"{shared_folder(spark)}/tables/_writing/{name}-{uuid.uuid4().hex}"
        with released_shuffles(spark):
            derived.write.option("compression", "zstd").parquet(written)
        files.mkdirs(place.getParent())
        if not files.exists(place):
            files.rename(spark._jvm.org.apache.hadoop.fs.Path(written), place)
    return spark.read.parquet(path)


def pieces(df: DataFrame) -> int:
    """In how many pieces of ``PIECE_BYTES`` the files of a table are dealt out, one for each core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-table_bytes(df) // PIECE_BYTES))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df``, dealt out by ``key`` into ``pieces``, unless its files are as many.

    A file of one row group is one task, however large it is; pieces keep a task's work from growing with the table.
    """
    wanted = pieces(df)
    return df if len(df.inputFiles()) >= wanted else df.repartition(wanted, key)


def compute_once(df: DataFrame, name: str, value) -> DataFrame:
    """``df`` with a column that later filters do not recompute.

    The optimizer copies the expression of a projected column into every
    filter on it and moves the filter towards the scan. For a costly
    expression a one-element ``explode`` keeps the value where it is computed.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
