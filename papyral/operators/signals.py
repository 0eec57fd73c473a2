"""Citations, similarity, scoring, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyral.functions import text as X
from papyral.functions import vectors as V
from papyral.operators.trends import paper_text

# Gates, weights and caps of the ranking.
THRESHOLDS = {"embedding_sim": 0.35, "lexical": 0.5, "cocitation_velocity": 2.0, "hf_upvotes": 20.0, "concept_overlap": 2.0}
RANK_WEIGHTS = {"embedding_sim": 3.0, "lexical": 1.0, "concept_overlap": 0.5, "cocitation_velocity": 1.0, "hf_upvotes": 0.5}
UNIVERSE_CAP, HARD_CAP, CROSS_CAP, PER_TAG = 1000, 60, 35, 4


def cocitation_velocity(edges: DataFrame, papers: DataFrame, as_of: Column, weeks: int = 6) -> DataFrame:
    """(cited_paper_id, velocity): distinct citing papers first seen within the last weeks."""
    recent = papers.where(F.col("first_seen") > F.date_sub(as_of, 7 * weeks)).select(F.col("paper_id").alias("citing_paper_id"))
    return edges.join(recent, "citing_paper_id").groupBy("cited_paper_id").agg(F.count_distinct("citing_paper_id").alias("velocity"))


def reference_edges(references: DataFrame, ids: DataFrame) -> DataFrame:
    """(citing_paper_id, cited_paper_id): exploded references resolved by external id; self citations left out."""
    return references.select("citing_paper_id", F.explode("referenced").alias("external_id")).join(ids, "external_id").where("citing_paper_id <> cited_paper_id").select("citing_paper_id", "cited_paper_id").distinct()


def citation_tiers(snapshots: DataFrame, hot: int = 5, warm: int = 1) -> DataFrame:
    """(paper_id, citation_count, delta_30d, tier): the latest count against the one nearest to 30 days before, at least 14 days old.

    Of two snapshots equally near the earlier counts.
    """
    latest = snapshots.groupBy("paper_id").agg(F.max(F.struct("snapshot_date", "citation_count")).alias("m")).select("paper_id", F.col("m.snapshot_date").alias("d"), F.col("m.citation_count").alias("citation_count"))
    gap = F.abs(F.datediff("snapshot_date", F.date_sub("d", 30)))
    old = snapshots.select("paper_id", "snapshot_date", F.col("citation_count").alias("c")).join(latest, "paper_id").where(F.col("snapshot_date") <= F.date_sub("d", 14))
    prior = old.groupBy("paper_id").agg(F.min(F.struct(gap.alias("gap"), F.col("snapshot_date"), F.col("c"))).alias("m")).select("paper_id", F.col("m.c").alias("c"))
    both = latest.join(prior, "paper_id", "left").withColumn("delta_30d", F.col("citation_count") - F.col("c"))
    tier = F.when(F.col("delta_30d").isNull(), "ndata").when(F.col("delta_30d") >= hot, "hot").when((F.col("delta_30d") < warm) & (F.col("delta_30d") <= 0), "flat").otherwise("warming")
    return both.select("paper_id", "citation_count", "delta_30d", tier.alias("tier"))


def missing_snapshots(papers: DataFrame, taken: DataFrame, as_of: Column, days: int = 14, limit: int = 400) -> DataFrame:
    """(paper_id) of papers first seen at least ``days`` ago that ``taken`` (paper_id) lacks; at most ``limit``, by id."""
    old = papers.where(F.to_date("first_seen_at") <= F.date_sub(as_of, days)).select("paper_id")
    return old.join(taken.select("paper_id"), "paper_id", "left_anti").orderBy("paper_id").limit(limit)


def missing_embeddings(papers: DataFrame, vectors: DataFrame) -> DataFrame:
    """(paper_id) of papers without a vector, each once."""
    return papers.select("paper_id").distinct().join(vectors.select("paper_id"), "paper_id", "left_anti")


def missing_abstracts(papers: DataFrame, limit: int = 50) -> DataFrame:
    """(paper_id, doi) of papers that have a DOI and no abstract; at most ``limit``, by id."""
    return papers.where(F.col("abstract").isNull() & F.col("doi").isNotNull()).select("paper_id", "doi").orderBy("paper_id").limit(limit)


def resolve_abstracts(papers: DataFrame, *found: DataFrame) -> DataFrame:
    """papers with missing abstracts filled from the first of ``found`` (paper_id, abstract) that has one."""
    out = papers
    for k, f in enumerate(found):
        out = out.join(f.groupBy("paper_id").agg(F.min("abstract").alias(f"__a{k}")), "paper_id", "left")
    filled = F.coalesce("abstract", *[f"__a{k}" for k in range(len(found))])
    return out.withColumns({"abstract": filled, "abstract_missing": filled.isNull()}).drop(*[f"__a{k}" for k in range(len(found))])


def tagged(papers: DataFrame, sources: DataFrame, as_of: Column, days: int = 45) -> DataFrame:
    """papers with concepts from recent payloads where they have none, and repository addresses from payloads, else from the abstract."""
    recent = sources.where(F.col("source").isin("openalex", "hf_daily") & (F.to_date("first_seen_at") > F.date_sub(as_of, days)))
    v = F.try_parse_json("raw")
    got = recent.select("paper_id", F.try_variant_get(v, F.lit("$.concepts"), "array<string>").alias("c"), F.try_variant_get(v, F.lit("$.repo"), "string").alias("r"))
    got = got.groupBy("paper_id").agg(F.max("c").alias("__c"), F.min("r").alias("__r"))
    out = papers.join(got, "paper_id", "left")
    concepts = F.when((F.size(F.coalesce("concepts", F.array().cast("array<string>"))) == 0) & F.col("__c").isNotNull(), F.col("__c")).otherwise(F.col("concepts"))
    return out.withColumns({"concepts": concepts, "repo_url": F.coalesce("repo_url", "__r", X.github_url(F.col("abstract")))}).drop("__c", "__r")


def latest_value(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(F.struct(at, value)).alias("m")).select(key, F.col(f"m.{value}").alias(value))


#: Anchors are broadcast up to so many rows; beyond, the join is left to the optimizer.
MAX_ANCHORS = 1000


def anchor_similarity(items: DataFrame, anchors: DataFrame) -> DataFrame:
    """(paper_id, anchor_id, sim) of every item and anchor."""
    few = anchors.select("anchor_id", F.col("v").alias("a"))
    few = F.broadcast(few) if few.limit(MAX_ANCHORS + 1).count() <= MAX_ANCHORS else few
    return items.select("paper_id", "v").crossJoin(few).select("paper_id", "anchor_id", V.cosine(F.col("v"), F.col("a")).alias("sim"))


def best_anchor(items: DataFrame, anchors: DataFrame) -> DataFrame:
    """(paper_id, sim, anchor_id): the most similar anchor above 0; else 0.0 and none.  Anchors are the configured statements (tens of rows)."""
    sims = anchor_similarity(items, anchors)
    best = sims.groupBy("paper_id").agg(F.max(F.when(F.col("sim") > 0, F.struct("sim", "anchor_id"))).alias("m"))
    return best.select("paper_id", F.coalesce("m.sim", F.lit(0.0)).alias("sim"), F.col("m.anchor_id").alias("anchor_id"))


def greatest_similarity(items: DataFrame, anchors: DataFrame) -> DataFrame:
    """(paper_id, sim): the greatest similarity to any anchor, which may be below 0."""
    return anchor_similarity(items, anchors).groupBy("paper_id").agg(F.max("sim").alias("sim"))


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """``norm_<c>`` of each column over all rows; a span of nothing gives 0."""
    ends = df.agg(*[F.min(F.coalesce(c, F.lit(0.0))).alias(f"lo_{c}") for c in columns], *[F.max(F.coalesce(c, F.lit(0.0))).alias(f"hi_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(ends))
    for c in columns:
        span = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        out = out.withColumn(f"norm_{c}", F.when(span <= 1e-9, 0.0).otherwise((F.coalesce(F.col(c), F.lit(0.0)) - F.col(f"lo_{c}")) / span))
    return out.drop(*[f"{x}_{c}" for c in columns for x in ("lo", "hi")])


def recall_gate(signals: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Rows that clear any threshold; null signals clear none."""
    passes = F.lit(False)
    for name, least in thresholds.items():
        passes = passes | F.coalesce(F.col(name) >= least, F.lit(False))
    return signals.where(passes)


def lexical(matched: DataFrame, weights: DataFrame, momentum: DataFrame) -> DataFrame:
    """(paper_id, lexical): sum over matched terms of weight times positive momentum."""
    value = F.col("weight") * F.greatest(F.lit(0.0), F.coalesce("momentum", F.lit(0.0)))
    return matched.join(weights, "term").join(momentum.select("term", "momentum"), "term", "left").groupBy("paper_id").agg(F.sum(value).alias("lexical"))


def composite(gated: DataFrame, weights: dict[str, float] = RANK_WEIGHTS) -> DataFrame:
    """``composite``: the weighted sum of min-max normalised signals over all gated rows."""
    out = min_max(gated, list(weights))
    total = sum((F.lit(w) * F.col(f"norm_{c}") for c, w in weights.items()), F.lit(0.0))
    return out.withColumn("composite", F.bround(total, 5))


def ranked(df: DataFrame, cap: int, *order: Column) -> DataFrame:
    """The first ``cap`` rows with ``rank`` 1..cap: a top-k first, so the one window holds cap rows only."""
    top = df.orderBy(*order).limit(cap)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def diversity_cap(df: DataFrame, tag: str, order: list[Column], per_tag: int = PER_TAG, cap: int = CROSS_CAP) -> DataFrame:
    """At most ``per_tag`` rows a tag, then at most ``cap`` in all; null tags share one tag."""
    rows = df.withColumn("__t", F.coalesce(F.col(tag), F.lit("—"))).withColumn("__rn", F.row_number().over(W.partitionBy("__t").orderBy(*order))).where(F.col("__rn") <= per_tag)
    return ranked(rows.drop("__t", "__rn"), cap, *order)


def niche_feed(papers: DataFrame, phrases: list[str], sims: DataFrame | None, as_of: Column, days: int = 14, cap: int = 1500, limit: int = 40, last_digest: DataFrame | None = None) -> DataFrame:
    """(paper_id, announce_date, similarity, matched, new_since_last_digest, rank): recent papers that match a niche phrase, newest first.

    similarity is the greatest to any open problem, to 4 places, 0 without a vector; it ranks unrounded.  last_digest:
    (paper_id) of the previous digest's niche cards.
    """
    recent = papers.where(~F.coalesce("muted", F.lit(False)) & ((F.col("first_seen_at").cast("date") > F.date_sub(as_of, days)) | (F.col("announce_date") > F.date_sub(as_of, days))))
    newest = recent.withColumn("day", F.coalesce("announce_date", F.col("first_seen_at").cast("date"))).orderBy(F.desc("day"), "paper_id").limit(cap)
    found = X.term_hits(paper_text(newest).select("paper_id", "announce_date", "text"), phrases).groupBy("paper_id").agg(F.max("announce_date").alias("announce_date"), F.array_sort(F.collect_set("term")).alias("matched"))
    rows = found.join(sims.select("paper_id", "sim"), "paper_id", "left") if sims is not None else found.withColumn("sim", F.lit(None).cast("double"))
    if last_digest is not None:
        rows = rows.join(last_digest.select("paper_id", F.lit(False).alias("__new")).distinct(), "paper_id", "left")
    new = F.coalesce(F.col("__new"), F.lit(True)) if last_digest is not None else F.lit(True)
    rows = rows.select("paper_id", "announce_date", F.coalesce("sim", F.lit(0.0)).alias("sim"), F.array_join("matched", "; ").alias("matched"), new.alias("new_since_last_digest"))
    top = ranked(rows, limit, F.desc_nulls_last("announce_date"), F.desc("sim"), F.col("paper_id"))
    return top.withColumn("similarity", F.bround("sim", 4)).drop("sim")


# The badge of each citation tier.
BADGES = {"hot": "🔥", "warming": "📈", "flat": "⚪", "ndata": "—"}


def universe(papers: DataFrame, as_of: Column, cap: int = UNIVERSE_CAP) -> DataFrame:
    """The newest papers, not muted, first seen in the last 10 days or announced in the last 21."""
    fresh = (F.col("first_seen_at").cast("date") > F.date_sub(as_of, 10)) | (F.col("announce_date") > F.date_sub(as_of, 21))
    return papers.where(~F.coalesce("muted", F.lit(False)) & fresh).orderBy(F.desc_nulls_last("first_seen_at"), "paper_id").limit(cap)


def score_signals(candidates: DataFrame, tracked: list[str], phrases: list[str], weights: DataFrame, momentum: DataFrame, vectors: DataFrame, anchors: DataFrame, velocity: DataFrame, upvotes: DataFrame) -> DataFrame:
    """The five signals of each candidate (a written table of at most UNIVERSE_CAP rows), with matched, in_domain and anchor_id.

    weights: (term, weight); momentum: (term, momentum); vectors: (paper_id, v); anchors: (anchor_id, v); velocity: (paper_id,
    velocity); upvotes: (paper_id, upvotes).  Every table is first cut to the candidates.  embedding_sim is null
    without a vector or anchors, 0 if no anchor is near; missing counts are 0.
    """
    of = lambda df: df.join(F.broadcast(candidates.select("paper_id")), "paper_id", "left_semi")  # noqa: E731  at most UNIVERSE_CAP ids
    text = paper_text(candidates).select("paper_id", "text")
    hits = X.term_hits(text, tracked)
    lex = lexical(hits, weights, momentum)
    matched = hits.groupBy("paper_id").agg(F.array_sort(F.collect_set("term")).alias("matched"))
    con = X.term_hits(candidates.select("paper_id", F.array_join("concepts", " ").alias("text")), tracked).groupBy("paper_id").agg(F.count("*").alias("con"))
    sims = best_anchor(of(vectors), anchors)
    rows = candidates.select("paper_id", "first_seen_at", X.matches_any(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))), phrases).alias("in_domain"))
    for x in (lex, matched, con, sims, of(velocity), of(upvotes)):
        rows = rows.join(x, "paper_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    nothing = F.array().cast("array<string>")
    return rows.select("paper_id", "first_seen_at", "in_domain", F.coalesce("matched", nothing).alias("matched"), "anchor_id", zero("lexical").alias("lexical"), F.bround("sim", 4).alias("embedding_sim"), zero("con").alias("concept_overlap"), zero("velocity").alias("cocitation_velocity"), zero("upvotes").alias("hf_upvotes"))


def score_broad(signals: DataFrame, hard_cap: int = HARD_CAP) -> dict[str, DataFrame]:
    """cards (in-domain, by composite, at most hard_cap), cross_domain (the others, by similarity, capped by tag and in all, no composite), summary.

    Both sections have cleared the same gate, and signals are normalised over both; the domain alone parts them.  summary:
    (surfaced, universe, truncated_at).
    """
    gated = composite(recall_gate(signals))
    order = [F.desc_nulls_last("first_seen_at"), F.col("paper_id")]
    own = gated.where("in_domain")
    cards = ranked(own, hard_cap, F.desc("composite"), *order)
    other = gated.where("NOT in_domain").withColumn("sim", F.coalesce("embedding_sim", F.lit(0.0))).withColumn("tag", F.try_element_at("matched", F.lit(1)))
    cross = diversity_cap(other, "tag", [F.desc("sim"), *order]).withColumn("composite", F.lit(None).cast("double"))
    n = own.agg(F.count("*").alias("n"))
    summary = n.crossJoin(F.broadcast(signals.agg(F.count("*").alias("universe")))).select(F.least("n", F.lit(hard_cap)).alias("surfaced"), "universe", F.when(F.col("n") > hard_cap, F.lit(hard_cap)).alias("truncated_at"))
    return {"cards": cards, "cross_domain": cross, "summary": summary}


def why(cards: DataFrame) -> Column:
    """Why a card is shown.  cards: matched, anchor_kind, anchor_text, embedding_sim, cocitation_velocity, hf_upvotes, tier, delta_30d."""
    some = F.array_join(F.transform(F.slice("matched", 1, 4), lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", ")
    near = F.concat(F.lit("near "), F.col("anchor_kind"), F.lit(": “"), X.shortened(F.coalesce(F.nullif("anchor_text", F.lit("")), F.col("anchor_kind")), 90), F.lit("” (sim "), F.col("embedding_sim").cast("string"), F.lit(")"))
    grown = lambda badge: F.concat(F.lit(f"{badge} +"), F.col("delta_30d").cast("string"), F.lit(" citations / 30d"))
    bits = F.concat_ws(
        "; ",
        F.when(F.size("matched") > 0, F.concat(F.lit("matches "), some)),
        F.when(F.col("anchor_kind").isNotNull(), near),
        F.when(F.col("cocitation_velocity") > 0, F.concat(F.lit("cited by "), F.col("cocitation_velocity").cast("int").cast("string"), F.lit(" recent paper(s)"))),
        F.when(F.col("hf_upvotes") > 0, F.concat(F.col("hf_upvotes").cast("int").cast("string"), F.lit(" HF upvotes"))),
        F.when(F.col("tier") == "hot", grown(BADGES["hot"])).when(F.col("tier") == "warming", grown(BADGES["warming"])),
    )
    return F.when(bits == "", F.lit("passed recall gate")).otherwise(bits)


def dressed(cards: DataFrame, papers: DataFrame, sources: DataFrame, tiers: DataFrame, anchors: DataFrame) -> DataFrame:
    """Ranked rows as cards: title, first 8 authors, link, sorted sources, citation tier and badge, anchor label, why.

    papers and tiers by paper_id; sources (paper_id, source); anchors (anchor_id, anchor_kind, anchor_text).
    """
    ids = F.broadcast(cards.select("paper_id"))  # capped
    bare = papers.join(ids, "paper_id", "left_semi").dropDuplicates(["paper_id"]).select("paper_id", "title", F.slice("authors", 1, 8).alias("authors"), "announce_date", "link", "abstract_missing")
    src = sources.join(ids, "paper_id", "left_semi").groupBy("paper_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    cited = tiers.join(ids, "paper_id", "left_semi").select("paper_id", "tier", "delta_30d")
    rows = cards.join(bare, "paper_id").join(src, "paper_id", "left").join(cited, "paper_id", "left").join(F.broadcast(anchors.select("anchor_id", "anchor_kind", "anchor_text")), "anchor_id", "left")
    rows = rows.withColumns({"tier": F.coalesce("tier", F.lit("ndata")), "sources": F.coalesce("sources", F.array().cast("array<string>"))})
    badge = F.element_at(F.create_map(*[F.lit(x) for kv in BADGES.items() for x in kv]), F.col("tier"))
    return rows.withColumns({"badge": badge, "why": why(rows), "anchor_label": X.shortened(F.coalesce(F.nullif("anchor_text", F.lit("")), F.col("anchor_kind")), 60)})


def by_tag(cards: DataFrame) -> DataFrame:
    """(place, tag, n): cards grouped by their first matched term in order of first appearance, untagged ones ("other") last."""
    tag = F.coalesce(F.try_element_at("matched", F.lit(1)), F.lit("other"))
    groups = cards.groupBy(tag.alias("tag")).agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    order = [F.col("tag") == "other", F.col("first")]
    return groups.withColumn("place", F.row_number().over(W.orderBy(*order))).select("place", "tag", "n")


def signals_ledger(cards: DataFrame, run: Column, names: list[str], rank_name: str = "rank") -> DataFrame:
    """(paper_id, run_date, name, value): a row for each signal of a displayed card that is not null, and its rank under ``rank_name``."""
    named = [*[(n, n) for n in names], (rank_name, "rank")]
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for n, c in named])
    return cards.select("paper_id", run.alias("run_date"), F.inline(pairs)).where("value is not null")
