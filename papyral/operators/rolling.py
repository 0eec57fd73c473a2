"""Rolling totals over trailing periods, kept as versioned state.

State has one row per (entity, period) at which something arrives or expires: the period's own amount, and the total of
each trailing window from there on until the entity's next row.  A new version is yesterday's totals joined
with what arrives and with what expires: an arrival of ``x`` in period ``p`` adds ``x`` from ``p`` on, and takes it off
again from ``p + k`` on, where it leaves the window of ``k`` periods.  A correction is an arrival of (new - old), so only
its dates change.  Periods are consecutive integers.  Versions lie in a folder that the caller may name, so the
next run starts from the last one.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyral.session import Scratch, Versions

#: Periods of the weekly range, as Mondays.
RANGE_START, RANGE_END = "2020-06-29", "2023-06-26"
WINDOWS = (4, 13)
#: Days of ``computed_at`` that one version of the state takes in.
STEP_DAYS = 364


def week_monday(label: Column) -> Column:
    """Monday of an ISO week typed as ``2021-W05``, ``2021w5``, ``2021/W05`` and so on; null if it is no week."""
    s = F.upper(F.trim(label))
    # Year, at most one sign, W, one or two digits; told without a regular expression, as every row is parsed.
    w_at = F.instr(s, "W")
    digits = F.substring(s, w_at + 1, F.lit(3))
    shaped = (F.length(s) <= 8) & w_at.isin(5, 6) & ((w_at == 5) | F.substring(s, 5, 1).isin("-", "/", " "))
    number = lambda c: F.when(shaped & (F.translate(c, "0123456789", "") == ""), c.try_cast("int"))
    y, w = number(F.substring(s, 1, 4)), number(digits)
    jan4 = F.make_date(y, F.lit(1), F.lit(4))
    monday = F.date_add(F.trunc(jan4, "WEEK").cast("date"), (w - 1) * 7)
    real = (w >= 1) & (w <= 53) & (F.extract(F.lit("YEAROFWEEK"), monday) == y)
    return F.when(real, monday)


def week_label(monday: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), monday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(monday).cast("string"), 2, "0"))


def clean_term(term: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(term, r"[\s ]+", " ")))


def weekly_amounts(term_counts: DataFrame) -> DataFrame:
    """(entity, period, amount, computed_at): rows of term_counts inside the range, as typed apart from spelling.

    Null terms and labels that are no ISO week are left out; a null count stays null here
    (it still replaces an older count, and adds 0).
    """
    period = (F.datediff(week_monday(F.col("iso_week")), F.lit(RANGE_START).cast("date")) / 7).cast("int")
    last = F.datediff(F.lit(RANGE_END).cast("date"), F.lit(RANGE_START).cast("date")) / 7
    return (
        term_counts.select(clean_term(F.col("term")).alias("entity"), period.alias("period"), F.col("count").cast("long").alias("amount"), "computed_at")
        .where(F.col("entity").isNotNull() & F.col("period").between(F.lit(0), last))
    )


def latest_amounts(rows: DataFrame, *by: str) -> DataFrame:
    """One row per (entity, period) and ``by``: the latest ``computed_at`` counts; at a tie the larger amount; repeats count once.

    A null ``computed_at`` is older than any other.
    """
    key = F.struct(F.col("computed_at"), F.col("amount"))
    return rows.groupBy("entity", "period", *by).agg(F.max(key).alias("m")).select("entity", "period", F.col("m.amount").alias("amount"), F.col("m.computed_at").alias("computed_at"), *by)


def advance(state: DataFrame | None, arrivals: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """The next version of the state.

    state: (entity, period, known, amount, computed_at, total_k ...), or None at the start; ``known`` marks periods that have
    an amount of their own.  arrivals: one row per (entity, period) (see :func:`latest_amounts`); one that is not later than
    what the state holds changes nothing.  One shuffle, by entity; an entity has at most a row a period there.
    """
    totals = [f"total_{k}" for k in windows]
    came = arrivals.select("entity", "period", F.lit(False).alias("held"), F.lit(True).alias("known"), "amount", "computed_at", *[F.lit(None).cast("bigint").alias(t) for t in totals])
    if state is not None:
        came = came.unionByName(state.select("entity", "period", F.lit(True).alias("held"), "known", "amount", "computed_at", *totals))
    came = came.repartition("entity")
    old, new = F.col("held") & F.col("known"), ~F.col("held")
    pick = lambda side: F.max(F.when(side, F.struct("computed_at", "amount")))
    met = came.groupBy("entity", "period").agg(pick(old).alias("old"), pick(new).alias("new"), *[F.max(t).alias(t) for t in totals], F.bool_or("held").alias("held"))
    wins = F.col("new").isNotNull() & (F.col("old").isNull() | (F.coalesce(F.col("new") > F.col("old"), F.lit(False))))
    met = met.withColumn("now", F.when(wins, F.col("new")).otherwise(F.col("old"))).withColumn("change", F.when(wins, F.coalesce("new.amount", F.lit(0)) - F.coalesce("old.amount", F.lit(0))).otherwise(F.lit(0)).cast("bigint"))
    # Yesterday's row with the arrival, and for each window the expiry of what arrived.
    none = F.lit(None).cast("bigint")
    stays = F.struct(F.col("period").alias("at"), F.col("now").alias("now"), F.col("now").isNotNull().alias("known"), *[F.col(t).alias(t) for t in totals], *[F.col("change").alias(f"d_{k}") for k in windows])
    leaves = [F.struct((F.col("period") + k).alias("at"), F.when(F.lit(False), F.col("now")).alias("now"), F.lit(False).alias("known"), *[none.alias(t) for t in totals], *[(-F.col("change") if j == k else F.lit(0).cast("bigint")).alias(f"d_{j}") for j in windows]) for k in windows]
    events = met.select("entity", F.inline(F.when(F.col("change") == 0, F.array(stays)).otherwise(F.array(stays, *leaves)))).where("known OR " + " OR ".join(f"d_{k} <> 0" for k in windows) + " OR " + " OR ".join(f"{t} IS NOT NULL" for t in totals))
    rows = events.groupBy("entity", F.col("at").alias("period")).agg(F.max("now").alias("now"), F.bool_or("known").alias("known"), *[F.max(t).alias(t) for t in totals], *[F.sum(f"d_{k}").alias(f"d_{k}") for k in windows])
    so_far = W.partitionBy("entity").orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    carried = [(F.coalesce(F.last(f"total_{k}", ignorenulls=True).over(so_far), F.lit(0)) + F.sum(f"d_{k}").over(so_far)).alias(f"total_{k}") for k in windows]
    return rows.select("entity", "period", "known", F.col("now.amount").alias("amount"), F.col("now.computed_at").alias("computed_at"), *carried)


def rolling_versions(spark: SparkSession, rows: DataFrame, windows: tuple[int, ...] = WINDOWS, step_days: int = STEP_DAYS, folder: str | None = None) -> DataFrame:
    """Run :func:`advance` over the arrivals of successive spans of ``computed_at``; each version is a written table in ``folder``.

    Returns the last version; a named folder that has versions already is gone on from.  rows are parsed once; every row
    is in exactly one step, so late and corrected rows change only their dates.
    """
    scratch = Scratch(spark, "rolling")
    kept = Versions(spark, folder or f"{scratch.root}/state")
    step = F.floor(F.coalesce(F.datediff("computed_at", F.lit(RANGE_START).cast("date")), F.lit(0)) / step_days).cast("int")
    parts = scratch.save(latest_amounts(rows.withColumn("step", F.greatest(step, F.lit(0))), "step"), "arrivals", by="step")
    state = kept.read()
    steps = [r["step"] for r in parts.select("step").distinct().orderBy("step").collect()]  # one row a span of time
    for s in steps or [0]:
        state = kept.write(advance(state, parts.where(F.col("step") == s), windows))
    if folder is None:
        kept.forget(kept.last())
    scratch.close()
    return state


def spans(state: DataFrame, last_period: int) -> DataFrame:
    """The state with ``until``: the last period up to ``last_period`` for which a row's totals hold."""
    after = F.lead("period").over(W.partitionBy("entity").orderBy("period"))
    return state.where(F.col("period") <= last_period).withColumn("until", F.coalesce(after - 1, F.lit(last_period)))


LAST_PERIOD = (datetime.fromisoformat(RANGE_END) - datetime.fromisoformat(RANGE_START)).days // 7


def rolling_totals(spark: SparkSession, term_counts: DataFrame) -> DataFrame:
    """Totals and averages of ``count`` over the trailing 4 and 13 weeks for every term and every week of the range.

    (term, iso_week, count, total_4, avg_4, total_13, avg_13); a week without a row has count 0.  The averages
    divide by 4 and 13 also at the start of the range, as earlier weeks add 0.  An empty table gives no rows.
    """
    state = spans(rolling_versions(spark, weekly_amounts(term_counts)), LAST_PERIOD)
    every = state.select("entity", "period", "amount", *[f"total_{k}" for k in WINDOWS], F.explode(F.sequence("period", "until")).alias("p"))
    # Weeks before the first row of a term have no span.
    first = state.groupBy("entity").agg(F.min("period").alias("f")).where("f > 0").select("entity", F.explode(F.sequence(F.lit(0), F.col("f") - 1)).alias("p"))
    full = every.unionByName(first, allowMissingColumns=True)
    monday = F.date_add(F.lit(RANGE_START).cast("date"), F.col("p") * 7)
    own = F.when(F.col("p") == F.col("period"), F.col("amount"))
    cols = [F.col("entity").alias("term"), week_label(monday).alias("iso_week"), F.coalesce(own, F.lit(0)).alias("count")]
    for k in WINDOWS:
        total = F.coalesce(F.col(f"total_{k}"), F.lit(0))
        cols += [total.alias(f"total_{k}"), (total / F.lit(float(k))).alias(f"avg_{k}")]
    return full.select(*cols)


def rising_weeks(spark: SparkSession, term_counts: DataFrame) -> DataFrame:
    """(term, iso_week) where the 4-week total is at least 12 and three times it exceeds twice the 13-week total."""
    state = spans(rolling_versions(spark, weekly_amounts(term_counts)), LAST_PERIOD)
    rising = state.where((F.col("total_4") >= 12) & (3 * F.col("total_4") > 2 * F.col("total_13"))).select("entity", F.explode(F.sequence("period", "until")).alias("p"))
    return rising.select(F.col("entity").alias("term"), week_label(F.date_add(F.lit(RANGE_START).cast("date"), F.col("p") * 7)).alias("iso_week"))
