"""Merging rows into a keyed table: one engine, a rule per column.

Storage has no keys and no MERGE: an upsert is a full outer join that returns the next version of the
table, which the caller writes to a new folder (a path that is being read is never overwritten).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyral.functions import text as X

RULES = {
    "first": lambda o, n: F.coalesce(o, n),  # first value that is not null
    "least": lambda o, n: F.least(o, n),
    "greatest": lambda o, n: F.greatest(o, n),
    "new": lambda o, n: F.coalesce(n, o),
    "union": lambda o, n: F.array_sort(F.array_distinct(F.concat(F.coalesce(o, F.array().cast("array<string>")), F.coalesce(n, F.array().cast("array<string>"))))),
    "or": lambda o, n: F.coalesce(o, F.lit(False)) | F.coalesce(n, F.lit(False)),
}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Rows of ``old`` merged with those of ``new`` by ``keys``; columns without a rule keep the old value if the row existed.

    ``keep`` is the rule of the others: the old row's value even if null.  Both sides must hold each key once.
    """
    columns = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*columns).alias("__o"))
    b = new.select(*keys, F.struct(*[c for c in columns if c in new.columns]).alias("__n"))
    joined = a.join(b, keys, "full")
    out: list[Column] = [F.col(k) for k in keys]
    for c in columns:
        o = F.col(f"__o.{c}")
        if c not in new.columns:
            out.append(o.alias(c))
            continue
        n = F.col(f"__n.{c}")
        merged = RULES[rules[c]](o, n) if c in rules else o
        out.append(F.when(F.col("__o").isNull(), n).when(F.col("__n").isNull(), o).otherwise(merged).alias(c))
    return joined.select(*out)


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the greatest ``seq`` of each key, whole.  Keys with a null part are left out."""
    rows = df
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(seq)))).where("__rn = 1").drop("__rn")


PAPER_RULES = {"abstract": "first", "doi": "first", "arxiv_id": "first", "first_author_group": "first", "published_date": "least", "announce_date": "least", "categories": "union", "is_survey": "or"}


def built_rows(raw: DataFrame) -> DataFrame:
    """Incoming records as rows of papers: key, white space, '' abstract as null, survey flag, first author's group."""
    year = F.year(F.coalesce("published_date", "announce_date"))
    abstract = F.when(F.col("abstract") != "", X.normalize_ws(F.col("abstract")))
    first = F.nullif(X.surname(F.try_element_at("authors", F.lit(1))), F.lit(""))
    return raw.select(
        X.canonical_key(F.col("doi"), F.col("arxiv_id"), F.col("title"), F.col("authors"), year).alias("paper_id"),
        X.normalize_ws(F.coalesce("title", F.lit(""))).alias("title"),
        abstract.alias("abstract"),
        "authors",
        first.alias("first_author_group"),
        F.nullif(F.trim("doi"), F.lit("")).alias("doi"),
        F.nullif(F.trim("arxiv_id"), F.lit("")).alias("arxiv_id"),
        "published_date",
        "announce_date",
        "categories",
        X.looks_like_survey(F.col("title"), F.col("abstract")).alias("is_survey"),
        F.col("raw_id").alias("seq"),
        "source",
    )


def merge_papers(old: DataFrame, batch: DataFrame) -> DataFrame:
    """papers after a batch: within the batch the last row of a key wins whole; then column by column."""
    new = last_wins(batch, ["paper_id"], "seq")
    merged = upsert(old, new, ["paper_id"], PAPER_RULES)
    return merged.withColumn("abstract_missing", F.col("abstract").isNull()) if "abstract" in merged.columns else merged


def provenance(sources: DataFrame) -> DataFrame:
    """(paper_id, source, source_id, source_url, raw, first_seen_at): one row a paper and source; the latest payload, the first sight."""
    rows = sources.where(F.col("paper_id").isNotNull() & F.col("source").isNotNull())
    out = rows.groupBy("paper_id", "source").agg(F.max(F.struct("first_seen_at", "source_id", "source_url", "raw")).alias("m"), F.min("first_seen_at").alias("first_seen_at"))
    return out.select("paper_id", "source", "m.source_id", "m.source_url", "m.raw", "first_seen_at")


def sources_of(sources: DataFrame) -> DataFrame:
    """(paper_id, sources, n): the sorted sources of each paper."""
    rows = sources.where(F.col("paper_id").isNotNull() & F.col("source").isNotNull())
    return rows.groupBy("paper_id").agg(F.array_sort(F.collect_set("source")).alias("sources")).withColumn("n", F.size("sources").cast("bigint"))


def source_report(sources: DataFrame) -> DataFrame:
    """(source, rows, papers, latest)."""
    return sources.groupBy("source").agg(F.count("*").alias("rows"), F.count_distinct("paper_id").alias("papers"), F.max("first_seen_at").alias("latest"))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks, one a key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))
