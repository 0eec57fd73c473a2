"""Clusters, records, and one whole day on a small corpus."""

from datetime import date, datetime

import numpy as np
from pyspark.sql import functions as F

from papyral import pipeline
from papyral.operators import clusters as G
from papyral.operators import lifecycle as C
from papyral.operators import records as D
from papyral.operators import signals as S

DAY = "2023-06-28"
VOCAB = "term string, weight float, is_seed boolean, last_seen_iso_week string"


def test_density_clusters_find_blobs(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((4, 12)) * 6
    v = np.concatenate([c + 0.3 * rng.standard_normal((15, 12)) for c in centres] + [rng.standard_normal((6, 12)) * 30])
    labels = G.density_labels(v)
    blobs = [set(labels[15 * k : 15 * k + 15].tolist()) for k in range(4)]
    assert all(len(b) == 1 and -1 not in b for b in blobs) and len(set.union(*blobs)) == 4
    assert (labels[60:] == -1).sum() >= 5
    rows = spark.createDataFrame([(f"p{i}", [float(x) for x in v[i]]) for i in range(60)], "paper_id string, v array<double>")
    assert G.density_clusters(rows).groupBy("label").count().select("count").collect() == [(15,)] * 4
    assert G.density_clusters(rows.limit(5)).count() == 0 and (G.density_labels(v[:5]) == -1).all()


def test_density_clusters_block_by_block(spark, monkeypatch):
    """Windows of more vectors than one task compares give the clusters that one task would give."""
    rng = np.random.default_rng(5)
    v = np.concatenate([c + 0.05 * (1 + k % 3) * rng.standard_normal((9 + k, 6)) for k, c in enumerate(rng.standard_normal((8, 6)))] + [rng.standard_normal((20, 6))])
    rows = spark.createDataFrame([(f"p{i:03d}", x.tolist()) for i, x in enumerate(v)], "paper_id string, v array<double>")
    want = {(f"p{i:03d}", int(k)) for i, k in enumerate(G.density_labels(v)) if k >= 0}
    monkeypatch.setattr(G, "BLOCK", 9)
    monkeypatch.setattr(G, "EDGES", 200)
    assert len(want) > 60 and len(set(dict(want).values())) > 3
    assert {tuple(r) for r in G.density_clusters(rows).collect()} == want


def test_cluster_keys_carry_over(spark):
    members = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (1, "x"), (1, "y"), (2, "a2")], "label int, paper_id string")
    before = spark.createDataFrame([("old", "a"), ("old", "b"), ("gone", "q")], "cluster_key string, paper_id string")
    out = {r["label"]: r for r in G.carried_keys(members, before, "2023-06").collect()}
    assert (out[0]["cluster_key"], out[0]["size"], out[0]["prev_size"]) == ("old", 3, 2)
    assert out[1]["cluster_key"].startswith("2023-06:") and out[1]["prev_size"] is None


def test_cards_keep_outcomes(spark):
    kind = "run_date date, paper_id string, section string, rank int, outcome string"
    old = spark.createDataFrame([(date(2023, 6, 28), "a", "broad", 1, "liked")], kind)
    new = spark.createDataFrame([(date(2023, 6, 28), "a", "broad", 3, None), (date(2023, 6, 28), "b", "broad", 1, None)], kind)
    out = {r["paper_id"]: (r["rank"], r["outcome"]) for r in D.put_cards(old, new).collect()}
    assert out == {"a": (3, "liked"), "b": (1, None)}


def test_run_log(spark):
    log = spark.createDataFrame([], "id bigint, run_date date, kind string, status string, started_at timestamp, finished_at timestamp, stats string, errors string")
    at = lambda text: F.lit(text).cast("timestamp")
    log = D.started(log, 1, F.lit(DAY).cast("date"), "daily", at("2023-06-28 01:00:00"))
    log = D.finished(log, 1, "ok", at("2023-06-28 01:10:00"), '{"n": 3}')
    log = D.started(log, 2, F.lit(DAY).cast("date"), "daily", at("2023-06-28 02:00:00"))
    out = {r["id"]: r["status"] for r in D.reap(log, at("2023-06-28 02:30:00")).collect()}
    assert out == {1: "ok", 2: "error"}
    assert D.no_recent_success(log, at("2023-06-29 02:00:00")).first()["stale"] is False
    assert D.no_recent_success(log, at("2023-06-29 04:00:00")).first()["stale"] is True
    assert D.no_recent_success(log.limit(0), at("2023-06-29 04:00:00")).first()["stale"] is None


def test_config(spark):
    vocab = spark.createDataFrame([("a", 0.4, False, None), ("b", 1.0, True, None)], VOCAB)
    seeds = spark.createDataFrame([("a", 2.0), ("c", 0.5)], "term string, weight double")
    out = {r["term"]: (round(r["weight"], 2), r["is_seed"]) for r in D.seed_sync(vocab, seeds).collect()}
    assert out == {"a": (0.4, True), "b": (1.0, True), "c": (0.5, True)}
    edited, added = D.edit_seeds(vocab, ["b"], {"a": 2.0, "d": 1.5})
    assert added == ["a", "d"] and {r["term"]: (r["weight"], r["is_seed"]) for r in edited.collect()} == {"a": (2.0, True), "b": (1.0, False), "d": (1.5, True)}
    good = {"niche_queries": ["x"], "broad_categories": ["cs.CL"], "open_problems": [], "seed_vocab": {"a": 1}}
    assert D.check_config(good) == []
    assert len(D.check_config({"niche_queries": [" x"], "broad_categories": [], "seed_vocab": {"a": 6}})) == 3


def test_feedback(spark):
    feedback = spark.createDataFrame([("a", "liked", False), ("b", "liked", True)], "paper_id string, verdict string, processed_for_vocab boolean")
    papers = spark.createDataFrame([("a", "graph kernel learning", None, False), ("b", "spectral token mixing", None, False)], "paper_id string, title string, abstract string, muted boolean")
    terms, after = C.growth(feedback, papers, spark.createDataFrame([("graph kernel",)], "term string"), learned=198)
    assert [(r["term"], r["weight"]) for r in terms.collect()] == [("kernel learning", 0.4)]
    assert {r["paper_id"]: r["processed_for_vocab"] for r in after.collect()} == {"a": True, "b": True}
    assert C.growth(after, papers, terms, learned=0)[0].count() == 0
    batch = spark.createDataFrame([("a", "muted", datetime(2023, 6, 28))], "paper_id string, verdict string, at timestamp")
    cards = spark.createDataFrame([("a", date(2023, 6, 20), None), ("a", date(2023, 1, 1), None)], "paper_id string, run_date date, outcome string")
    kept, muted, marked = C.apply_feedback(feedback, batch, papers, cards, F.lit(DAY).cast("date"))
    assert {r["paper_id"]: (r["verdict"], r["processed_for_vocab"]) for r in kept.collect()} == {"a": ("muted", False), "b": ("liked", True)}
    assert {r["paper_id"]: r["muted"] for r in muted.collect()} == {"a": True, "b": False}
    assert {r["run_date"]: r["outcome"] for r in marked.collect()} == {date(2023, 6, 20): "muted", date(2023, 1, 1): None}


def test_paging(spark):
    rows = spark.createDataFrame([(i, date(2023, 6, 28 - i)) for i in range(20)], "seq int, published_date date")
    kept, cursor = D.paged(rows, F.lit("2023-06-20").cast("date"), 5, most=2)
    assert kept.count() == 9 and cursor.first()[0] is None
    kept, cursor = D.paged(rows, F.lit("2020-01-01").cast("date"), 5, most=2)
    assert kept.count() == 10 and cursor.first()[0] == 10


def test_abstracts_and_tags(spark):
    papers = spark.createDataFrame([("a", None, "d", [], None), ("b", "see https://github.com/x/y now", None, ["k"], None)], "paper_id string, abstract string, doi string, concepts array<string>, repo_url string")
    found = spark.createDataFrame([("a", "text")], "paper_id string, abstract string")
    out = {r["paper_id"]: (r["abstract"], r["abstract_missing"]) for r in S.resolve_abstracts(papers, found.limit(0), found).collect()}
    assert out["a"] == ("text", False)
    sources = spark.createDataFrame([("a", "openalex", '{"concepts": ["c1"], "repo": null}'), ("b", "openalex", '{"concepts": ["c2"]}')], "paper_id string, source string, raw string").withColumn("first_seen_at", F.lit("2023-06-20").cast("timestamp"))
    tagged = {r["paper_id"]: (r["concepts"], r["repo_url"]) for r in S.tagged(papers, sources, F.lit(DAY).cast("date")).collect()}
    assert tagged == {"a": (["c1"], None), "b": (["k"], "https://github.com/x/y")}


def test_parse_vector(spark):
    df = spark.createDataFrame([("[1,2.5]",), ("{1,2}",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(D.parse_vector(F.col("t"))).collect()] == [[1.0, 2.5], [1.0, 2.0], None, None]


def day_tables(spark):
    t = lambda kind: spark.createDataFrame([], kind)
    papers = "paper_id string, canonical_key string, arxiv_id string, doi string, title string, abstract string, abstract_missing boolean, authors array<string>, first_author_group string, published_date date, announce_date date, link string, categories array<string>, concepts array<string>, repo_url string, is_survey boolean, muted boolean, first_seen_at timestamp"
    anchors = spark.createDataFrame([("0", "open_problem", "when do graph kernels fail", [1.0, 0.0])], "anchor_id string, anchor_kind string, anchor_text string, v array<double>")
    vocab = spark.createDataFrame([("graph kernel", 1.0, True, None), ("faded", 0.01, False, None)], VOCAB)
    return {
        "papers": t(papers), "paper_sources": t("paper_id string, source string, raw string, first_seen_at timestamp"), "vocab": vocab, "term_counts": t("term string, iso_week string, count bigint, distinct_authors bigint"),
        "vectors": t("paper_id string, v array<double>"), "anchors": anchors, "edges": t("citing_paper_id string, cited_paper_id string"), "snapshots": t("paper_id string, snapshot_date date, citation_count int"), "upvotes": t("paper_id string, snapshot_date date, upvotes bigint"),
        "feedback": t("paper_id string, verdict string, processed_for_vocab boolean"), "digest_cards": t("run_date date, paper_id string, section string, rank int, outcome string"), "digests": t("run_date date, mode string, broad_ranked string, cross_domain string, niche_papers string, rising_terms string, bursts string, clusters_summary string, papers_scanned bigint"),
        "clusters": t("period string, cluster_key string, label_terms array<string>, member_paper_ids array<string>, representative_paper_ids array<string>, size bigint, prev_size bigint"), "discovery": t("run_date date, term string, tier string, current_count bigint, baseline_count double, delta double"), "markers": t("marker string"),
    }


def test_a_whole_day(spark):
    kind = "raw_id bigint, source string, title string, abstract string, authors array<string>, doi string, arxiv_id string, published_date date, announce_date date, categories array<string>"
    rows = [(i, "arxiv", f"A graph kernel for case {i}", "on rare events" if i % 2 else "of planner tokens", [f"Ann L{'abc'[i % 3]}"], None, f"2306.0000{i}", date(2023, 6, 27), date(2023, 6, 27), ["cs.LG"]) for i in range(6)]
    incoming = spark.createDataFrame(rows, kind)
    cfg = pipeline.Config({"graph kernel": 1.0}, ('abs:"rare events" AND abs:"vision-language"',))
    one = pipeline.run_daily(spark, day_tables(spark), incoming, cfg, DAY)
    assert [(r["term"], r["iso_week"], r["count"]) for r in one["term_counts"].collect()] == [("graph kernel", "2023-W26", 6)]
    assert [r["term"] for r in one["vocab"].collect()] == ["graph kernel"]  # the faded term was pruned
    cards = one["digest_cards"].collect()
    broad = [r["paper_id"] for r in cards if r["section"] == "broad"]
    cross = [r["paper_id"] for r in cards if r["section"] == "cross_domain"]
    assert len(broad) == 3 and len(cross) == 3 and not set(broad) & set(cross)
    assert len([r for r in cards if r["section"] == "niche"]) == 3
    text = one["text"].first()[0]
    assert "Rising terms:\n  graph kernel  Δ+6  (now 6)" in text and "matches 'graph kernel'" in text and "*new*" in text
    assert one["digests"].count() == 1 and one["discovery"].where("term = 'rare events'").count() == 1
    # The same day again: nothing is counted twice, decay is claimed already.
    two = pipeline.run_daily(spark, {k: one[k] for k in day_tables(spark)}, incoming, cfg, DAY)
    assert two["digests"].count() == 1 and two["papers"].count() == 6 and two["term_counts"].collect() == one["term_counts"].collect()
    assert round(two["vocab"].first()["weight"], 3) == round(one["vocab"].first()["weight"], 3) == 0.97
    assert {(r["paper_id"], r["section"], r["rank"]) for r in two["digest_cards"].collect()} == {(r["paper_id"], r["section"], r["rank"]) for r in cards}
    state = D.state(two["digests"], two["vocab"], spark.createDataFrame([], "id bigint, status string, created_at timestamp"), spark.createDataFrame([], "id bigint"), two["discovery"], two["digest_cards"], F.lit("2023-07-02").cast("date"))
    assert state["staleness"].first()["stale"] is True and state["digest"].count() == 1
    assert state["discovery"].count() <= 30 and state["vocab"].count() == 1
