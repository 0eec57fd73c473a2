"""Matching entities across sources without keys: a cascade of deterministic rules.

Each rule is an exact join on a combination of attributes that is weaker than the one before (see RULES); records
that a rule resolves are taken out by an anti-join before the next.  What meets is checked as a whole: titles that agree
but for slips, people that do not contradict.  A rule's confidence is its precision on labelled pairs of papers
(verdicts of match_pairs, put through the same keys and the same check), smoothed by one success and one failure.

Papers that are one work (see :mod:`papyral.llm.incremental`) are resolved together: a record that
meets one of them is matched to all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyral.llm.incremental import BUCKET_ROWS, FingerprintIndex
from papyral.llm.works import block_keys, same_people, same_title, work_features
from papyral.session import Scratch, table

RULES = ("title and author", "title and year", "title, a date missing", "two title blocks and author", "three title blocks and year", "three title blocks, a date missing")
#: Years from a preprint to its venue, and back, within which rules with a year join.
YEARS_AFTER, YEARS_BEFORE = 5, 1


def _people(c: str = "people") -> Column:
    return F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def rule_keys(rows: DataFrame, rule: int, later: bool) -> DataFrame:
    """(id, key) of features with published_date: what rule joins on.  ``later``: the side published after the other.

    The earlier side has its year as its key, the later one every year that may precede its own; where a date is
    missing, rows without one meet those with any: the dated have the key of the rule both with and without it.
    """
    year = F.year("published_date")
    span = F.sequence(year - YEARS_AFTER, year + YEARS_BEFORE) if later else F.array(year)
    if rule in (0, 3):
        extra = _people()
    elif rule in (1, 4):
        extra = F.when(year.isNotNull(), F.transform(span, lambda y: y.cast("string"))).otherwise(F.array().cast("array<string>"))
    else:
        extra = F.array(F.lit(""))
    rows = rows.withColumn("__x", extra)
    if rule < 3:
        return rows.select("id", F.explode("__x").alias("x"), "title").select("id", F.xxhash64("title", "x").alias("key"))
    front = block_keys(rows, _people(), "id", "__x")
    if rule == 3:
        return front.where("t < 6 OR t = 10").select("id", "key")
    return front.where("t BETWEEN 6 AND 9").select("id", "key", F.explode("__x").alias("x")).select("id", F.xxhash64("key", "x").alias("key"))


def _agree(pairs: DataFrame, left: DataFrame, right: DataFrame, rule: int | None) -> DataFrame:
    """The rows of pairs (u, v, ...) whose titles and people agree; of the rules that need it, a date must be missing."""
    side = lambda df, key: df.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}_{key}") for c in ("tokens", "people", "published_date")])
    kept = pairs.columns
    rows = pairs.join(side(left, "u"), "u").join(side(right, "v"), "v")
    undated = F.col("published_date_u").isNull() | F.col("published_date_v").isNull()
    rows = rows.where(undated) if rule in (2, 5) else rows if rule is not None else rows.where(~F.col("rule").isin(2, 5) | undated)
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = ([x.split() for x in row] for row in zip(*(batch.column(i).to_pylist() for i in range(n, n + 4))))
            good = [(sorted(tu) == sorted(tv) or same_title(tu, tv)) and same_people(pu, pv) for tu, pu, tv, pv in words]
            yield batch.select(list(range(n))).filter(pa.array(good, pa.bool_()))

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, "tokens_u", "people_u", "tokens_v", "people_v").mapInArrow(run, kinds)


def rule_precision(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rule, fired, same, confidence) of every rule on the labelled pairs of papers; features by id = paper_id.

    Pairs whose latest verdict is same or different are labels; a pair counts for the first rule that joins it, whichever
    of the two is taken as the later; confidence = (same + 1) / (fired + 2).
    """
    verdict = F.lower(F.trim("verdict"))
    usable = pairs.where(F.col("left_key").isNotNull() & F.col("right_key").isNotNull() & (F.col("left_key") != F.col("right_key")))
    known = usable.groupBy(F.least("left_key", "right_key").alias("a"), F.greatest("left_key", "right_key").alias("b")).agg(F.max(F.struct(F.col("decided_at"), verdict.alias("w"))).alias("m"))
    known = known.where(F.col("m.w").isin("same", "different")).select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))), (F.col("m.w") == "same").alias("same"))
    asked = features.join(known.select(F.col("u").alias("id")).distinct(), "id", "left_semi")
    keys = lambda later: [rule_keys(asked, n, later).select("id", F.lit(n).alias("rule"), "key") for n in range(len(RULES))]
    every = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(every(parts[1:]))
    later, earlier = every(keys(True)).withColumnRenamed("id", "u"), every(keys(False)).withColumnRenamed("id", "v")
    met = known.join(later, "u").join(earlier, ["v", "rule", "key"]).select("u", "v", "same", "rule").distinct()
    joined = _agree(met, asked, asked, None)
    first = joined.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min("rule").alias("rule"), F.max("same").alias("same"))
    counted = first.groupBy("rule").agg(F.count("*").alias("fired"), F.count_if("same").alias("same"))
    named = features.sparkSession.createDataFrame([(i, x) for i, x in enumerate(RULES)], "rule int, name string")
    filled = named.join(counted, "rule", "left").select("rule", "name", F.coalesce("fired", F.lit(0)).alias("fired"), F.coalesce("same", F.lit(0)).alias("same"))
    return filled.withColumn("confidence", (F.col("same") + 1) / (F.col("fired") + 2))


def match_records(spark: SparkSession, records: DataFrame, papers: DataFrame, labels: DataFrame) -> DataFrame:
    """(record_id, paper_id, rule, confidence) for every papers row of the work that a record names.

    Null or empty titles match nothing; without authors on either side the title and the dates decide; repeated rows count once.
    """
    scratch = Scratch(spark, "matching")
    plain = papers.where(F.col("paper_id").isNotNull()).select(F.col("paper_id").alias("id"), "title", "authors", "doi", "arxiv_id", "published_date").distinct()
    right = scratch.save(work_features(plain, ("published_date",)), "papers")
    index = FingerprintIndex(spark, buckets=max(4, right.count() // BUCKET_ROWS))
    index.append(right)
    works = scratch.save(index.vertices(right).distinct().join(index.works(), "vertex", "left").select("id", F.coalesce("work", "vertex").alias("work")), "works")
    right = right.where("title IS NOT NULL").drop("doi", "arxiv")
    nothing = F.lit(None).cast("string")
    rows = records.where(F.col("record_id").isNotNull()).select(F.col("record_id").alias("id"), "title", "authors", nothing.alias("doi"), nothing.alias("arxiv_id"), "published_date").distinct()
    left = scratch.save(work_features(rows, ("published_date",)).where("title IS NOT NULL"), "records")
    confidence = scratch.save(rule_precision(right, labels), "precision")
    found: DataFrame | None = None
    for n in range(len(RULES)):
        rest = left if found is None else left.join(found.select(F.col("u").alias("id")).distinct(), "id", "left_anti")
        a, b = rule_keys(rest, n, True).withColumnRenamed("id", "u"), rule_keys(right, n, False).withColumnRenamed("id", "v")
        hit = a.join(b, "key").select("u", "v").distinct()
        if n:  # the whole title and a name word in common need no further check
            hit = _agree(hit, left, right, n)
        hit = scratch.save(hit.withColumn("rule", F.lit(n)), f"rule{n}")
        found = hit if found is None else found.unionByName(hit)
    whole = found.join(works.withColumnRenamed("id", "v"), "v").groupBy("u", "work").agg(F.min("rule").alias("rule"))
    out = whole.join(works, "work").groupBy(F.col("u").alias("record_id"), F.col("id").alias("paper_id")).agg(F.min("rule").alias("rule"))
    return out.join(confidence.select("rule", "name", "confidence"), "rule").select("record_id", "paper_id", F.col("name").alias("rule"), "confidence")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_records(spark, table(spark, sf_dir, "venue_records"), table(spark, sf_dir, "papers"), table(spark, sf_dir, "match_pairs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("record_id", "paper_id")


def p7_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches with the rule that made each and its confidence."""
    return _matched(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))
