"""Building blocks that keep big or skewed groups out of a single task.

Everything here works on ordered chunks: rows are range-partitioned on the group
key and the order columns, so one key with a third of all rows is spread over many
partitions; what one chunk needs to know of the earlier ones travels through a
frame with at most one row for each (partition, key) pair.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Name of the column with the number of the ordered chunk.
PID = "__chunk"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where it is set.

    Only a local master without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if path:
        return path
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(f"file://{own}")
    return sc.getCheckpointDir()


#: Shuffle files go when the write that made them has ended, not when the driver collects its garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    ``free`` removes the shuffle files of the write at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE)
    try:
        if free:
            spark.conf.set(FREE, "true")
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(FREE, before)
    _left[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the files of frames that came from :func:`materialize` and that nothing will read again."""
    for df in frames:
        path = getattr(df, "_written", None)
        if path in _left:
            _remove(_left.pop(path), path)


#: Written folders that still stand, with their session.
_left: dict[str, SparkSession] = {}


def _remove_left() -> None:
    for path, spark in _left.items():
        _remove(spark, path)
    _left.clear()


atexit.register(_remove_left)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the gateway may be gone at exit; the folder's owner cleans it then
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_chunks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in range partitions by ``keys + order``, written once, with the partition's number.

    A key's chunks follow each other in the order of ``__chunk``.
    """
    n = shuffle_partitions(df.sparkSession)
    cut = df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in [*keys, *order]])
    return materialize(cut.withColumn(PID, F.spark_partition_id()))


def _spanning(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """A row for each (chunk, key) of the keys that lie in several chunks: at most two a partition."""
    per = df.groupBy(PID, *keys).agg(*aggs)
    return per.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("__n > 1").drop("__n")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on (chunk, keys) where null keys match each other; ``right`` has at most two rows a partition."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") for c in [PID, *keys]], *[c for c in right.columns if c not in [PID, *keys]])
    on = F.lit(True)
    for c in [PID, *keys]:
        on = on & left[c].eqNullSafe(r[f"__r_{c}"])
    return left.join(F.broadcast(r), on, "left").drop(*[f"__r_{c}" for c in [PID, *keys]])


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Running totals, this row included, of each of ``sums`` within ``keys`` by ``order``.

    No key is gathered: a window runs over (chunk, key) and earlier chunks' totals are added.
    ``order`` must make rows of a key distinct for the totals to be unique.
    """
    d = ordered_chunks(df, keys, order)
    w = Window.partitionBy(PID, *keys).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    names = list(sums)
    before = Window.partitionBy(*keys).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    small = _spanning(d, keys, [F.sum(e).alias(f"__o_{n}") for n, e in sums.items()])
    small = small.select(PID, *keys, *[F.coalesce(F.sum(f"__o_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in names])
    out = _null_safe(d.withColumns({n: F.sum(e).over(w) for n, e in sums.items()}), small, keys)
    return out.withColumns({n: F.col(n) + F.coalesce(F.col(f"__o_{n}"), F.lit(0)) for n in names}).drop(PID, *[f"__o_{n}" for n in names])


def carry_last(chunked: DataFrame, keys: list[str], order: list[str], name: str, value: Column) -> DataFrame:
    """Adds ``name``: the last non-null ``value`` of the key's earlier rows, over chunk borders.

    ``chunked`` comes from :func:`ordered_chunks`.
    """
    w = Window.partitionBy(PID, *keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    d = chunked.withColumn("__v", value)
    ordered = F.struct(*order)
    small = _spanning(d, keys, [F.max_by("__v", F.when(F.col("__v").isNotNull(), ordered)).alias("__last")])
    before = Window.partitionBy(*keys).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    small = small.select(PID, *keys, F.last("__last", ignorenulls=True).over(before).alias("__carry"))
    d = d.withColumn(name, F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    out = _null_safe(d, small, keys)
    return out.withColumn(name, F.coalesce(F.col(name), F.col("__carry"))).drop("__v", "__carry")


def carry_next(chunked: DataFrame, keys: list[str], order: list[str], name: str, value: Column) -> DataFrame:
    """Adds ``name``: the ``value`` of the key's next row (a lead), over chunk borders."""
    w = Window.partitionBy(PID, *keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    d = chunked.withColumn("__v", value)
    small = _spanning(d, keys, [F.min_by("__v", F.struct(*order)).alias("__first")])
    small = small.select(PID, *keys, F.lead("__first").over(Window.partitionBy(*keys).orderBy(PID)).alias("__carry"))
    d = d.withColumn(name, F.lead("__v").over(w))
    out = _null_safe(d, small, keys)
    return out.withColumn(name, F.coalesce(F.col(name), F.col("__carry"))).drop("__v", "__carry")
