from datetime import date, datetime

from papyral.streaming.ingest import first_deliveries, ingest, ingested, weekly_counts

SCHEMA = "raw_id bigint, title string, abstract string, authors array<string>, doi string, arxiv_id string, published_date date, announce_date date, categories array<string>, source string"


def test_ingest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "T", None, ["A B"], "10.1/x", None, date(2024, 1, 1), None, ["c"], "s"), (2, "T", "abs", ["A B"], "10.1/X", None, date(2024, 1, 2), None, ["d"], "s"), (3, "U", None, [], "10.1/y", None, None, None, [], "s")], SCHEMA)
    landed, papers, checkpoint = str(tmp_path / "landed"), f"file://{tmp_path}/papers", str(tmp_path / "ck")
    assert ingested(spark, papers, 4) is None
    rows.write.parquet(landed)
    ingest(spark, landed, SCHEMA, papers, checkpoint, parts=4)
    assert {r["paper_id"]: r["abstract"] for r in ingested(spark, papers, 4).collect()} == {"doi:10.1/x": "abs", "doi:10.1/y": None}
    rows.where("raw_id = 3").selectExpr("4 AS raw_id", "'V' AS title", "'later' AS abstract", "authors", "doi", "arxiv_id", "published_date", "announce_date", "categories", "source").write.mode("append").parquet(landed)
    ingest(spark, landed, SCHEMA, papers, checkpoint, parts=4)
    assert {r["paper_id"]: (r["title"], r["abstract"]) for r in ingested(spark, papers, 4).collect()} == {"doi:10.1/x": ("T", "abs"), "doi:10.1/y": ("U", "later")}


def run(spark, tmp_path, made, name, mode):
    query = made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_weekly_counts_and_repeats(spark, tmp_path):
    rows = spark.createDataFrame([("a", datetime(2024, 3, 24, 12)), ("a", datetime(2024, 3, 24, 13)), ("b", datetime(2024, 3, 25))], "k string, at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert {r["monday"]: r["count"] for r in run(spark, tmp_path, weekly_counts(stream(), "at"), "weekly_test", "complete")} == {date(2024, 3, 18): 2, date(2024, 3, 25): 1}
    assert sorted(r["k"] for r in run(spark, tmp_path, first_deliveries(stream(), ["k"], "at"), "first_test", "append")) == ["a", "b"]
