"""Incremental ingest: landed files to the next version of papers, and weekly counts with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyral.operators.upsert import built_rows, last_wins, merge_papers
from papyral.session import Versions

#: Parts of papers by a hash of the key; a micro-batch rewrites the parts that it touches.
PARTS = 64


def ingest(spark: SparkSession, landed: str, schema, papers_root: str, checkpoint: str, parts: int = PARTS) -> None:
    """Merge every landed file once into ``papers_root``, kept in parts ``part=<k>`` by a hash of the key, each in numbered versions.

    Each micro-batch reads and rewrites only the parts that its keys fall into: a new version is written whole beside the old
    one, then it counts.  A batch that is run again after a failure finds the same rows merged and changes nothing.
    """

    def merge(batch: DataFrame, n: int) -> None:
        rows = last_wins(built_rows(batch), ["paper_id"], "seq").withColumn("part", F.pmod(F.xxhash64("paper_id"), F.lit(parts)).cast("int")).persist()
        try:
            touched = [r["part"] for r in rows.select("part").distinct().collect()]  # at most ``parts``
            for k in touched:
                kept = Versions(spark, f"{papers_root}/part={k}")
                new = rows.where(F.col("part") == k).drop("part")
                old = kept.read()
                old = new.drop("seq", "source").limit(0) if old is None else old
                kept.write(merge_papers(old, new).select(*old.columns))
                kept.forget(kept.last() - 1)
        finally:
            rows.unpersist()

    stream = spark.readStream.schema(schema).parquet(landed)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingested(spark: SparkSession, papers_root: str, parts: int = PARTS) -> DataFrame | None:
    """The papers that :func:`ingest` has merged so far; None if there are none."""
    whole = [df for k in range(parts) if (df := Versions(spark, f"{papers_root}/part={k}").read()) is not None]
    out = None
    for df in whole:
        out = df if out is None else out.unionByName(df)
    return out


def weekly_counts(stream: DataFrame, at: str, lateness: str = "14 days") -> DataFrame:
    """Rows a Monday-based week; rows later than the watermark are dropped by the stream (a recompute counts them)."""
    return weekly(stream.withWatermark(at, lateness), at)


def weekly(rows: DataFrame, at: str) -> DataFrame:
    """(monday, count) of a timestamp column, batch or stream."""
    return rows.groupBy(F.window(at, "7 days", "7 days", "4 days").alias("w")).agg(F.count("*").alias("count")).select(F.col("w.start").cast("date").alias("monday"), "count")


def first_deliveries(stream: DataFrame, keys: list[str], at: str, lateness: str = "14 days") -> DataFrame:
    """A stream without records whose key came before, within the watermark."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)
