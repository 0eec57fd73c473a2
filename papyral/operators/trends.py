"""Weekly counts, momentum, bursts and discovery of terms."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyral.functions import text as X
from papyral.functions import weeks as K

MOMENTUM_LOOKBACK, BURST_WINDOW = 6, 3
DISCOVERY_LOOKBACK, FIRST_MIN, BURST_MIN, TOP, RESERVED = 8, 2, 3, 25, 8


def paper_text(papers: DataFrame) -> DataFrame:
    return papers.withColumn("text", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))))


def eligible(papers: DataFrame) -> DataFrame:
    """Papers that count for momentum: not muted, no survey, dated.  Adds ``iso_week``."""
    day = F.coalesce("announce_date", "published_date")
    return papers.where(~F.coalesce("muted", F.lit(False)) & ~F.coalesce("is_survey", F.lit(False)) & day.isNotNull()).withColumn("iso_week", K.iso_week(day))


def hits(papers: DataFrame, terms: list[str]) -> DataFrame:
    """(paper_id, term, iso_week, first_author_group): one scan for all terms."""
    return X.term_hits(paper_text(eligible(papers)).select("paper_id", "iso_week", "first_author_group", "text"), terms)


def term_counts(term_hits: DataFrame) -> DataFrame:
    """(term, iso_week, count, distinct_authors): papers and distinct groups; null groups count for none."""
    return term_hits.groupBy("term", "iso_week").agg(F.count("*").alias("count"), F.count_distinct("first_author_group").alias("distinct_authors"))


def category_volume(papers: DataFrame) -> DataFrame:
    rows = eligible(papers).select("iso_week", F.explode("categories").alias("category"))
    return rows.groupBy("iso_week", "category").agg(F.count("*").alias("count"))


def last_seen(counts: DataFrame) -> DataFrame:
    return counts.where("count > 0").groupBy("term").agg(F.max("iso_week").alias("last_seen_iso_week"))


def momentum(counts: DataFrame, terms: list[str], current: str, lookback: int = MOMENTUM_LOOKBACK) -> DataFrame:
    """(term, current, baseline, momentum) of every asked term, to 3 places; weeks without a row are 0."""
    rows = counts.where(F.col("iso_week").isin(*K.plan_weeks(current, lookback)) & F.col("term").isin(*terms))
    got = rows.groupBy("term").agg(F.sum(F.when(F.col("iso_week") == current, F.col("count"))).alias("c"), F.sum(F.when(F.col("iso_week") != current, F.col("count"))).alias("b"))
    asked = counts.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    full = asked.join(got, "term", "left").select("term", F.coalesce("c", F.lit(0)).alias("current"), (F.coalesce("b", F.lit(0)) / F.lit(float(lookback))).alias("b"))
    return full.select("term", "current", F.bround("b", 3).alias("baseline"), F.bround(F.col("current") - F.col("b"), 3).alias("momentum"))


def rising(table: DataFrame, n: int = 8) -> DataFrame:
    """The n terms of greatest momentum: positive ones only, or of all if none is positive."""
    best = table.agg(F.max("momentum").alias("best"))
    rows = table.crossJoin(F.broadcast(best)).where((F.col("momentum") > 0) | (F.col("best") <= 0)).drop("best")
    return rows.orderBy(F.desc("momentum"), F.desc("current"), "term").limit(n)


def momentum_all_weeks(counts: DataFrame, first: str, last: str, lookback: int = MOMENTUM_LOOKBACK) -> DataFrame:
    """(term, iso_week, count, baseline, momentum) of every week of the range, weeks without a row being 0."""
    start = F.lit(K.plan_days(first, 0)[0]).cast("date")
    n = (date.fromisoformat(K.plan_days(last, 0)[0]) - date.fromisoformat(K.plan_days(first, 0)[0])).days // 7
    spine = counts.select("term").distinct().select("term", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("w"))
    spine = spine.withColumn("iso_week", K.iso_week(F.date_add(start, F.col("w") * 7)))
    rows = spine.join(counts.select("term", "iso_week", "count"), ["term", "iso_week"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    before = W.partitionBy("term").orderBy("w").rangeBetween(-lookback, -1)
    base = F.coalesce(F.sum("count").over(before), F.lit(0)) / F.lit(float(lookback))
    return rows.select("term", "iso_week", "count", F.bround(base, 3).alias("baseline"), F.bround(F.col("count") - base, 3).alias("momentum"))


def bursts(term_hits: DataFrame, terms: list[str], current: str, least: int = 3, window: int = BURST_WINDOW) -> DataFrame:
    """(term, distinct_groups, prev_distinct_groups, bursting): groups of the last weeks against those of the weeks before."""
    weeks = K.plan_weeks(current, 2 * window - 1)
    now = F.col("iso_week").isin(*weeks[window:])
    groups = term_hits.where(F.col("iso_week").isin(*weeks) & F.col("first_author_group").isNotNull())
    got = groups.groupBy("term").agg(F.count_distinct(F.when(now, F.col("first_author_group"))).alias("k"), F.count_distinct(F.when(~now, F.col("first_author_group"))).alias("p"))
    asked = term_hits.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    full = asked.join(got, "term", "left").select("term", F.coalesce("k", F.lit(0)).alias("distinct_groups"), F.coalesce("p", F.lit(0)).alias("prev_distinct_groups"))
    return full.withColumn("bursting", (F.col("distinct_groups") >= least) & (F.col("distinct_groups") > F.col("prev_distinct_groups"))).orderBy(F.desc("distinct_groups"), "term")


def all_bursts(term_hits: DataFrame, window: int = BURST_WINDOW) -> DataFrame:
    """(term, monday, distinct_groups): distinct groups of every sliding window of weeks, by the window's last week.

    A distinct count cannot slide, so each row goes to the windows that hold it; (term, window, group) is made
    distinct before counting.
    """
    rows = term_hits.where(F.col("first_author_group").isNotNull()).select("term", "first_author_group", K.monday(F.col("day")).alias("m")).distinct()
    spread = rows.select("term", "first_author_group", F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("k"), "m").select("term", "first_author_group", F.date_add("m", F.col("k") * 7).alias("monday")).distinct()
    return spread.groupBy("term", "monday").agg(F.count("*").alias("distinct_groups"))


def discovery_groups(papers: DataFrame, tracked: list[str], current: str) -> DataFrame:
    """(gram, current_count, weeks_seen, baseline_count, distinct): distinct groups a gram in this week and in the weeks before."""
    first, last = K.plan_days(current, DISCOVERY_LOOKBACK)
    day = F.coalesce("announce_date", F.col("first_seen_at").cast("date"))
    rows = papers.where(~F.coalesce("muted", F.lit(False)) & ~F.coalesce("is_survey", F.lit(False)) & day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    rows = paper_text(rows.withColumn("iso_week", K.iso_week(day)))
    group = F.coalesce("first_author_group", F.concat(F.lit("anon:"), F.substring("title", 1, 40)))
    grams = F.array_union(X.bigrams(F.col("text")), X.acronyms(F.col("text")))
    if tracked:
        grams = F.array_except(grams, F.array(*[F.lit(t) for t in tracked]))
    flat = rows.select(F.explode(grams).alias("gram"), "iso_week", group.alias("g")).distinct()
    now = F.col("iso_week") == current
    per = flat.groupBy("gram").agg(F.count_if(now).alias("current_count"), F.count_if(~now).alias("before"))
    return per.withColumn("baseline", F.col("before") / F.lit(float(DISCOVERY_LOOKBACK)))


def discovery(papers: DataFrame, tracked: list[str], current: str) -> DataFrame:
    """(term, tier, current_count, baseline_count, delta) of untracked phrases and coinages that are new or bursting.

    A tier shows 25: up to 8 coinages (terms without a space) and phrases for the other places.  Ties by term.
    """
    per = discovery_groups(papers, tracked, current)
    first = (F.col("before") == 0) & (F.col("current_count") >= FIRST_MIN)
    burst = (F.col("before") > 0) & (F.col("current_count") >= BURST_MIN) & (F.col("current_count") > F.col("baseline"))
    tiers = per.select(F.col("gram").alias("term"), F.when(first, "first_appearance").when(burst, "bursting").alias("tier"), "current_count", "baseline").where(F.col("tier").isNotNull())
    rows = tiers.select("term", "tier", "current_count", F.bround(F.when(F.col("tier") == "bursting", F.col("baseline")).otherwise(0.0), 2).alias("baseline_count"), F.bround(F.col("current_count") - F.when(F.col("tier") == "bursting", F.col("baseline")).otherwise(0.0), 2).alias("delta"))
    coined = ~F.col("term").contains(" ")
    place = F.row_number().over(W.partitionBy("tier", coined).orderBy(F.desc("delta"), "term"))
    # Only the best of each class are needed: 25 rows a class at most.
    best = rows.withColumn("coined", coined).withColumn("rn", place).where(F.col("rn") <= TOP)
    taken = F.count_if(F.col("coined") & (F.col("rn") <= RESERVED)).over(W.partitionBy("tier"))
    return best.withColumn("taken", taken).where(F.when(F.col("coined"), F.col("rn") <= RESERVED).otherwise(F.col("rn") <= TOP - F.col("taken"))).drop("coined", "rn", "taken")


def tracked_terms(*lists: DataFrame) -> DataFrame:
    out = lists[0].select("term")
    for x in lists[1:]:
        out = out.unionByName(x.select("term"))
    return out.distinct()


def recompute(stored: DataFrame, fresh: DataFrame, keys: list[str], only_weeks: list[str] | None = None) -> DataFrame:
    """A weekly table after a recount: rows of ``only_weeks`` (all if None) take the fresh values; a week that fell to nothing keeps its row."""
    fresh = fresh if only_weeks is None else fresh.where(F.col("iso_week").isin(*only_weeks))
    return stored.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def refresh_last_seen(vocab: DataFrame, counts: DataFrame) -> DataFrame:
    """vocab with ``last_seen_iso_week`` moved forward, never back, to each term's last week with a count."""
    seen = last_seen(counts).withColumnRenamed("last_seen_iso_week", "__w")
    return vocab.join(seen, "term", "left").withColumn("last_seen_iso_week", F.greatest("last_seen_iso_week", "__w")).drop("__w")
