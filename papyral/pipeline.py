"""One daily run over the tables of the engine, in the order that its rules need.

Seeds are synchronised and incoming records merged; decay and pruning come before counting, once a week by a marker; counting before
momentum; tags before scoring; the digest is stored before feedback grows the vocabulary, which so counts from the next run on.
Every table that a later step reads is written first, so no plan grows over the run and a lost executor costs one step.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyral.functions import text as X
from papyral.functions import weeks as K
from papyral.operators import clusters as G
from papyral.operators import lifecycle as C
from papyral.operators import records as D
from papyral.operators import signals as S
from papyral.operators import trends as T
from papyral.operators import upsert as U
from papyral.session import Scratch


@dataclass(frozen=True)
class Config:
    seeds: dict[str, float]
    niche_queries: tuple[str, ...] = ()
    mode: str = "calibration"
    decay: float = C.DECAY
    prune_below: float = C.PRUNE_BELOW
    silent_weeks: int = C.SILENT_WEEKS
    burst_groups: int = 3
    model: str = ""
    thresholds: dict[str, float] = field(default_factory=lambda: dict(S.THRESHOLDS))


def phrases_of(cfg: Config, spark: SparkSession) -> tuple[list[str], list[str]]:
    """(niche phrases, domain markers) of the configured queries."""
    if not cfg.niche_queries:
        return [], []
    one = spark.range(1).select(F.array(*[F.lit(q) for q in cfg.niche_queries]).alias("q"))
    row = one.select(F.array_sort(F.array_distinct(F.flatten(F.transform("q", X.quoted_phrases)))).alias("p"), X.domain_markers(F.col("q")).alias("m")).first()
    return list(row["p"]), list(row["m"])


def run_daily(spark: SparkSession, tables: dict[str, DataFrame], incoming: DataFrame, cfg: Config, today: str) -> dict[str, DataFrame]:
    """The tables after the run of the day ``today``, and ``text``, the digest to deliver.

    tables: papers, paper_sources, vocab (term, weight, is_seed, last_seen_iso_week), term_counts, vectors (paper_id, v), anchors (anchor_id,
    anchor_kind, anchor_text, v), edges (citing_paper_id, cited_paper_id), snapshots, upvotes (paper_id, snapshot_date, upvotes), feedback,
    digest_cards, digests, clusters, discovery, markers.  incoming: rows of the feeds (see :func:`papyral.operators.upsert.built_rows`).
    """
    scratch = Scratch(spark, "daily")
    t, as_of = dict(tables), F.lit(today).cast("date")
    week = spark.range(1).select(K.iso_week(as_of)).first()[0]

    def put(name: str, df: DataFrame) -> DataFrame:
        t[name] = scratch.save(df, name)
        return t[name]

    seeds = spark.createDataFrame([(k, float(w)) for k, w in cfg.seeds.items()], "term string, weight double")
    vocab = D.seed_sync(t["vocab"], seeds)
    new = scratch.save(U.built_rows(incoming), "built")
    first = new.groupBy("paper_id").agg(F.max("seq").alias("seq"))
    merged = U.merge_papers(t["papers"], new.join(first, ["paper_id", "seq"], "left_semi"))
    merged = merged.withColumns({"first_seen_at": F.coalesce("first_seen_at", as_of.cast("timestamp")), "muted": F.coalesce("muted", F.lit(False))})
    put("papers", S.tagged(merged, t["paper_sources"], as_of))
    t["markers"], due = D.claim(t["markers"], f"decay:{week}")
    if due:
        seen = F.to_date(F.lit(K.plan_days(week, 0)[0]))
        dated = C.decay(vocab, cfg.decay).withColumn("last_seen_monday", week_day("last_seen_iso_week"))
        vocab = C.prune(dated, seen, cfg.prune_below, cfg.silent_weeks).drop("last_seen_monday")
    vocab = put("vocab", vocab)
    tracked = sorted(r["term"] for r in vocab.select("term").collect())  # the vocabulary is a parameter list of a few hundred terms
    hits = scratch.save(T.hits(t["papers"], tracked), "hits")
    counts = put("term_counts", T.recompute(t["term_counts"], T.term_counts(hits), ["term", "iso_week"], [week]))
    vocab = put("vocab", T.refresh_last_seen(vocab, counts))
    momentum = scratch.save(T.momentum(counts, tracked, week), "momentum")
    rising = scratch.save(T.rising(momentum), "rising")
    bursts = scratch.save(T.bursts(hits, tracked, week, cfg.burst_groups).where("bursting"), "bursts")
    found = scratch.save(T.discovery(t["papers"], tracked, week).withColumn("run_date", as_of), "discovery")
    put("discovery", D.replace_by(t["discovery"], found, "run_date"))
    phrases, markers = phrases_of(cfg, spark)
    candidates = scratch.save(S.universe(t["papers"], as_of), "candidates")
    seen_at = t["papers"].select("paper_id", F.to_date("first_seen_at").alias("first_seen"))
    velocity = S.cocitation_velocity(t["edges"], seen_at, as_of).withColumnRenamed("cited_paper_id", "paper_id")
    votes = S.latest_value(t["upvotes"], "paper_id", "snapshot_date", "upvotes")
    signals = scratch.save(S.score_signals(candidates, tracked, markers, vocab.select("term", F.col("weight").cast("double").alias("weight")), momentum, t["vectors"], t["anchors"], velocity, votes), "signals")
    broad = S.score_broad(signals)
    tiers = S.citation_tiers(t["snapshots"])
    cards = scratch.save(S.dressed(broad["cards"], t["papers"], t["paper_sources"], tiers, t["anchors"]), "cards")
    cross = scratch.save(S.dressed(broad["cross_domain"], t["papers"], t["paper_sources"], tiers, t["anchors"]), "cross")
    problems = t["anchors"].where("anchor_kind = 'open_problem'")
    before = t["digest_cards"].where((F.col("section") == "niche") & (F.col("run_date") < as_of))
    last = before.join(before.agg(F.max("run_date").alias("run_date")), "run_date", "left_semi")
    niche = S.niche_feed(t["papers"], phrases, S.greatest_similarity(t["vectors"], problems), as_of, last_digest=last)
    niche = scratch.save(niche.join(t["papers"].select("paper_id", "title", "link"), "paper_id"), "niche")
    period = today[:7]
    earlier = t["clusters"].where(F.col("period") < period)
    previous = earlier.join(earlier.agg(F.max("period").alias("period")), "period", "left_semi").select("cluster_key", F.explode("member_paper_ids").alias("paper_id"))
    made = scratch.save(G.cluster_recent(t["papers"], t["vectors"], previous, as_of, period), "made")
    put("clusters", t["clusters"].join(made.select("period", "cluster_key"), ["period", "cluster_key"], "left_anti").unionByName(made))
    ledger = S.signals_ledger(cards, as_of, list(S.RANK_WEIGHTS), "composite_rank").unionByName(S.signals_ledger(cross, as_of, list(S.RANK_WEIGHTS), "cross_domain_rank"))
    put("signals", ledger)
    scanned = new.select("paper_id").distinct().count()
    sections = {"broad_ranked": cards, "cross_domain": cross, "niche_papers": niche, "rising_terms": rising, "bursts": bursts, "clusters_summary": G.rollup(t["clusters"])}
    put("digests", D.replace_by(t["digests"], D.digest_row(as_of, cfg.mode, sections, scanned), "run_date"))
    put("digest_cards", D.put_cards(t["digest_cards"], D.card_rows(as_of, broad=cards, cross_domain=cross, niche=niche)))
    learned = vocab.where("NOT is_seed").count()
    grown, feedback = C.growth(t["feedback"], t["papers"], vocab, learned)
    grown = grown.select("term", F.col("weight").cast("float").alias("weight"), F.lit(False).alias("is_seed"))
    put("vocab", U.insert_absent(vocab, grown.withColumn("last_seen_iso_week", F.lit(None).cast("string")).select(*vocab.columns), ["term"]))
    put("feedback", feedback)
    put("text", D.delivery_text(today, cfg.mode, scanned, cards, niche, cross, rising, bursts, found))
    return t


def week_day(label: str):
    """The Monday of a column of labels ``IYYY-Www``."""
    from papyral.operators.rolling import week_monday

    return week_monday(F.col(label))
