"""Session helpers: table access and durable intermediate tables.

Lineage is cut by writing a Parquet table into the folder that the session names
in ``spark.checkpoint.dir`` (shared by all executors on a cluster, so a lost
executor costs nothing).  Where the setting is absent, a session on this machine
alone, as in tests, gets a temporary folder; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="papyral-")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``; unset, a local one, if the session runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return _local_dir()
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, a Parquet file or folder ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def trim_driver(spark: SparkSession) -> bool:
    """Give back to the system what the driver's JVM has freed outside its heap; False where a JVM can't (Linux, JDK 17.0.9 on, can).

    Planning and compiling hundreds of queries leaves the C library with much freed memory that still counts as the driver's.
    """
    sc = spark.sparkContext
    jvm, made = sc._jvm, sc._gateway.new_array
    named = jvm.java.lang.Class.forName
    kinds, values = made(jvm.java.lang.Class, 4), made(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = named(kind)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JJavaError:  # another JVM or system
        return False
    return True


class Scratch:
    """Intermediate tables of one run, written under the shared folder."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/papyral/{tag}-{uuid.uuid4().hex[:12]}", 0
        self.paths: list[str] = []

    def save(self, df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
        """Write ``df`` and return the table read back: the plan behind it is gone.  ``by``: a column to partition the folder by."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._papyral_path = path
        self.paths.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables made by :meth:`save` that nothing reads any more."""
        for df in tables:
            path = getattr(df, "_papyral_path", None)
            if path in self.paths:
                self.paths.remove(path)
                _delete(self.spark, path)

    def close(self, *kept: DataFrame) -> None:
        """Delete all tables of the run but those that the result still reads."""
        stay = {getattr(df, "_papyral_path", None) for df in kept}
        for path in [p for p in self.paths if p not in stay]:
            self.paths.remove(path)
            _delete(self.spark, path)


class Versions:
    """A table kept as numbered versions ``v=<n>`` in a folder of the caller's: a version is written whole, then it counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def last(self) -> int:
        """The number of the last whole version; 0 if there is none."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v=*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return max((int(f.getPath().getParent().getName()[2:]) for f in found or ()), default=0)

    def read(self, n: int | None = None) -> DataFrame | None:
        n = n or self.last()
        return self.spark.read.parquet(f"{self.folder}/v={n}") if n else None

    def write(self, df: DataFrame, n: int | None = None) -> DataFrame:
        """Write the next version (or version ``n`` again, after a failure) and return it."""
        n = n or self.last() + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/v={n}")
        return self.read(n)

    def forget(self, before: int) -> None:
        """Delete the versions older than ``before``."""
        for n in range(1, before):
            _delete(self.spark, f"{self.folder}/v={n}")


#: Most bytes that Spark keeps of listings of files, for all of a session.
LISTINGS = "spark.sql.hive.filesourcePartitionFileCacheSize"


@contextmanager
def unlisted(spark: SparkSession) -> Iterator[None]:
    """Relations made within keep their own listing of files only.

    Spark would keep a second one of each, on the driver and beyond the table, up to 250 MB; a table that is appended to and
    read again and again makes a new relation every time, each with all of its files.
    """
    before = spark.conf.get(LISTINGS, None)
    spark.conf.set(LISTINGS, "0")
    try:
        yield
    finally:
        spark.conf.unset(LISTINGS) if before is None else spark.conf.set(LISTINGS, before)


class Buckets:
    """A lasting table in a folder of the caller's, hashed into buckets by one column, that only grows.

    A join on that column reads it bucket by bucket, without a shuffle of what is stored; a later session opens the
    same folder and appends to it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, n: int):
        self.spark, self.path, self.schema, self.key, self.n = spark, path.rstrip("/"), schema, key, n
        self.name = f"papyral_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        with unlisted(spark):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}) USING parquet CLUSTERED BY ({key}) INTO {n} BUCKETS LOCATION '{self.path}'")

    def placed(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """``df`` shuffled as the buckets are, by the column ``by`` (the key itself if None)."""
        return df.repartition(self.n, by or self.key)

    def append(self, df: DataFrame, placed: bool = False) -> None:
        """Add rows; one file a bucket.  ``placed``: they are shuffled by the key already."""
        columns = [c.split()[0] for c in self.schema.split(", ")]
        rows = df.select(*columns)
        with unlisted(self.spark):
            (rows if placed else self.placed(rows)).write.mode("append").option("parquet.dictionary.page.size", 8 << 20).insertInto(self.name)
            self.spark.catalog.refreshTable(self.name)

    def read(self) -> DataFrame:
        with unlisted(self.spark):
            return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        _delete(self.spark, self.path)


#: A key is heavy if it holds this share of the rows, so there are at most 1 / HEAVY of them.
HEAVY = 1 / 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, heavy: list, parts: int = 64) -> DataFrame:
    """``left`` inner-joined with ``right`` (one row a key), the rows of the ``heavy`` keys spread over ``parts`` partitions.

    ``heavy`` lists the keys with at least the share HEAVY of left's rows (1,000 at most), so it can travel in the plan.
    """
    if not heavy:
        return left.join(right, key)
    hot: Column = F.col(key).isin(heavy)
    a = left.withColumn("__salt", F.when(hot, (F.rand(7) * parts).cast("int")).otherwise(0))
    b = right.withColumn("__salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [key, "__salt"]).drop("__salt")
