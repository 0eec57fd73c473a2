"""Mixing sources to target weights: entropy balancing of token sizes.

Each document gets the rate that is closest in relative entropy to one copy a document while
its source's tokens meet their target: rate = min(cap, exp(lambda * n)) with n the document's
tokens.  The dual is convex, with one multiplier a source; Newton steps (kept inside a shrinking bracket)
find all multipliers at once, each step one small distributed aggregate over the
(source, n) histogram, which is all that the dual needs of the corpus.  Rates are then rounded
into whole copies by systematic rounding in order of size, so that the tokens of a source miss its target by
at most about one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyral.llm.tokens import encode_corpus
from papyral.session import Scratch, table

NEWTON_STEPS, TOLERANCE = 60, 1e-9
#: Equal documents (source and size) are numbered in so many parts, so that none is a hot group.
SALTS = 32


def clean_source(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), r"[-\s]+", "_")


def balanced_rates(histogram: DataFrame, targets: list[tuple[str, float, int]], total: float | None = None) -> tuple[dict[str, float], float, int]:
    """(multiplier a source, total tokens, Newton steps).

    histogram: (source, n, docs) with n > 0.  targets: (source, share, cap); shares of sources without tokens are
    spread over the others in proportion.  total: tokens wanted; by default, and at most, the largest for which every
    source can hold its share under its cap.  Source keys are few (a parameter table), so one row each comes to the driver.
    """
    size = {r["source"]: (r["t"], r["m"]) for r in histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("docs")).alias("t"), F.max("n").alias("m")).collect()}
    live = [(s, share, cap) for s, share, cap in targets if share > 0 and cap > 0 and size.get(s, (0, 0))[0]]
    if not live:
        return {}, 0.0, 0
    scale = sum(share for _, share, _ in live)
    largest = min(cap * size[s][0] / (share / scale) for s, share, cap in live)
    total = largest if total is None else min(total, largest)
    want = {s: total * share / scale for s, share, _ in live}
    caps = {s: cap for s, _, cap in live}
    # Multipliers are per token of the mean document, brackets in that unit.
    low, high, at, done = {s: -60.0 for s in want}, {s: 60.0 for s in want}, {s: 0.0 for s in want}, {}
    unit = {s: float(size[s][1]) for s in want}
    for s in want:  # a source used up to its cap has no finite multiplier
        if want[s] >= caps[s] * size[s][0] * (1 - 1e-9):
            at[s], done[s] = high[s] * unit[s], True
    spark = histogram.sparkSession
    for step in range(NEWTON_STEPS):
        now = [(s, at[s] / unit[s], float(math.log(caps[s]))) for s in want if s not in done]
        if not now:
            break
        rows = histogram.join(F.broadcast(spark.createDataFrame(now, "source string, l double, top double")), "source")
        x = F.col("l") * F.col("n")
        free = x < F.col("top")
        rate = F.exp(F.least(x, F.col("top")))
        sums = rows.groupBy("source").agg(F.sum(rate * F.col("n") * F.col("docs")).alias("f"), F.sum(F.when(free, rate * F.col("n") * F.col("n") * F.col("docs")).otherwise(0.0)).alias("g")).collect()
        for r in sums:
            s, miss = r["source"], r["f"] - want[r["source"]]
            if abs(miss) <= TOLERANCE * want[s] or high[s] - low[s] < 1e-12:
                done[s] = True
                continue
            if miss > 0:
                high[s] = at[s]
            else:
                low[s] = at[s]
            step_to = at[s] - miss * unit[s] / r["g"] if r["g"] > 0 else math.inf
            # Newton inside the bracket, else its middle; a source at its cap ends at the upper bracket.
            at[s] = step_to if low[s] < step_to < high[s] else (low[s] + high[s]) / 2
    return {s: at[s] / unit[s] for s in want}, total, step


def mixture(spark: SparkSession, documents: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, shares).

    copies: (doc_id, source, n_tokens, copies) of every document used at least once.  shares: (source, target_share,
    documents, tokens, share) of every named source, with the share actually reached; a named source
    without documents has 0.  Sources are matched apart from case, spaces and hyphens; documents of unnamed or null
    sources, and texts without tokens (null, empty), are not used.  copies never exceeds max_repeats.
    """
    scratch = Scratch(spark, "mixing")
    named = targets.where(F.col("source").isNotNull()).groupBy(clean_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    goal = [(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in named.collect()]
    known = documents.select("doc_id", "text", clean_source(F.col("source")).alias("source")).where(F.col("source").isin([s for s, _, _ in goal]))
    sized = scratch.save(encode_corpus(known, count_only=True, keep=("source",)).where("n_tokens > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "sized")
    histogram = scratch.save(sized.groupBy("source", F.col("n_tokens").alias("n"), "salt").agg(F.count("*").alias("docs")), "histogram")
    multipliers, _, _ = balanced_rates(histogram.groupBy("source", "n").agg(F.sum("docs").alias("docs")), goal, total)
    caps = {s: cap for s, _, cap in goal}
    rates = spark.createDataFrame([(s, v, float(caps[s])) for s, v in multipliers.items()], "source string, l double, cap double")
    rate = F.least(F.exp(F.least(F.col("l") * F.col("n"), F.log("cap"))), F.col("cap"))
    classes = histogram.join(F.broadcast(rates), "source").withColumn("rate", rate)
    # Expected copies before each class, in order of size: two prefix sums, over sizes and within one.
    before = F.sum(F.col("docs") * F.col("rate")).over(W.partitionBy("source").orderBy("n", "salt")) - F.col("docs") * F.col("rate")
    classes = scratch.save(classes.select("source", F.col("n").alias("n_tokens"), "salt", "rate", before.alias("before")), "classes")
    place = F.row_number().over(W.partitionBy("source", "n_tokens", "salt").orderBy("doc_id"))
    ranked = sized.withColumn("k", place).join(classes, ["source", "n_tokens", "salt"])
    start = F.col("before") + (F.col("k") - 1) * F.col("rate")
    copies = (F.floor(start + F.col("rate") + 0.5 + 1e-9) - F.floor(start + 0.5 + 1e-9)).cast("int")
    out = scratch.save(ranked.select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0"), "copies")
    used = out.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    shares = named.join(used, "source", "left").select("source", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    whole = out.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("whole"))
    shares = shares.crossJoin(F.broadcast(whole)).select("source", "target_share", "documents", "tokens", F.coalesce(F.try_divide("tokens", "whole"), F.lit(0.0)).alias("share"))
    return out, shares


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]
