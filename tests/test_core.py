"""Golden micro-cases of the core functions and operators."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from papyral.functions import text as X
from papyral.functions import vectors as V
from papyral.functions import weeks as K
from papyral.operators import lifecycle as C
from papyral.operators import rolling as R
from papyral.operators import signals as S
from papyral.operators import trends as T
from papyral.operators import upsert as U
from papyral.sources import feeds


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_word_match(spark):
    rows = [(1, "foreground segmentation"), (2, "grounded"), (3, "evaluated against Ground truth"), (4, None), (5, "éground")]
    out = X.term_hits(spark.createDataFrame(rows, "id int, text string"), ["ground"]).collect()
    assert [r["id"] for r in out] == [3]
    assert X.term_hits(spark.createDataFrame(rows, "id int, text string"), []).count() == 0


def test_weeks(spark):
    assert one(spark, K.iso_week(F.col("d")), d=date(2021, 1, 3)) == "2020-W53"
    assert one(spark, K.labels_before(F.col("d"), 2), d=date(2021, 1, 5)) == ["2020-W52", "2020-W53"]
    assert K.plan_weeks("2021-W01", 2) == ["2020-W52", "2020-W53", "2021-W01"] and K.plan_days("2021-W01", 1) == ("2020-12-28", "2021-01-10")
    assert spark.range(1).select(K.weeks_between(R.week_monday(F.lit("2020-W52")), R.week_monday(F.lit("2021-W01")))).first()[0] == 2
    assert one(spark, K.months_back(F.col("d"), 2), d=date(2021, 3, 31)) == date(2021, 1, 28) and one(spark, K.month(F.col("d")), d=date(2021, 3, 31)) == "2021-03"


@pytest.mark.parametrize(("doi", "arxiv", "key"), [(" HTTPS://DOI.ORG/10.1/X ", None, "doi:10.1/x"), (None, "2401.00001V2", "arxiv:2401.00001")])
def test_key(spark, doi, arxiv, key):
    row = spark.createDataFrame([(doi, arxiv, "t", ["A B"], 2020)], "d string, a string, t string, p array<string>, y int")
    assert row.select(X.canonical_key(*[F.col(c) for c in "datpy"])).first()[0] == key


@pytest.mark.parametrize(("name", "want"), [("Jane Q. Doe", "doe"), ("Doe, Jane", "doe"), ("José Núñez", "nunez"), ("Thị Nguyễn", "nguyen"), ("Zoë Łukaſz", "ukasz"), ("ﬁnn Eﬀert", "effert"), ("李明", "")])
def test_surname(spark, name, want):
    assert one(spark, X.surname(F.col("n")), n=name) == want


def test_phrases(spark):
    assert one(spark, X.bigrams(F.col("t")), t="deep, learning rate schedule") == ["learning rate", "rate schedule"]
    assert one(spark, X.bigrams(F.col("t")), t="graph (neural) kernel") == ["graph kernel"]
    assert sorted(one(spark, X.acronyms(F.col("t")), t="JEPA LoRA MedJEPA RLHF AI MRI GPT4 V2X")) == ["jepa", "lora", "medjepa", "rlhf"]
    assert one(spark, X.significant_words(F.col("t")), t="ECG signal hallucination detection") == ["ecg", "hallucination"]


def test_momentum(spark):
    counts = spark.createDataFrame([("a", "2021-W03", 3), ("a", "2021-W06", 3)], "term string, iso_week string, count bigint")
    out = {r["term"]: r for r in T.momentum(counts, ["a", "b"], "2021-W06").collect()}
    assert (out["a"]["baseline"], out["a"]["momentum"]) == (0.5, 2.5)
    assert out["b"]["current"] == 0


def test_tiers(spark):
    rows = [("a", date(2024, 3, 1), 4), ("a", date(2024, 4, 5), 13), ("b", date(2024, 3, 26), 1), ("b", date(2024, 4, 5), 9)]
    out = {r["paper_id"]: (r["tier"], r["delta_30d"]) for r in S.citation_tiers(spark.createDataFrame(rows, "paper_id string, snapshot_date date, citation_count int")).collect()}
    assert out == {"a": ("hot", 9), "b": ("ndata", None)}


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_merge_is_idempotent(spark):
    schema = "paper_id string, title string, abstract string, doi string, arxiv_id string, first_author_group string, published_date date, announce_date date, categories array<string>, is_survey boolean"
    old = spark.createDataFrame([("k", "T", None, None, None, None, date(2024, 5, 2), None, ["a"], False)], schema)
    new = spark.createDataFrame([("k", "U", "x", "d", None, "g", date(2024, 5, 1), None, ["b"], True, 1)], schema + ", seq int")
    once = U.merge_papers(old, new)
    row = once.first()
    assert (row["title"], row["abstract"], row["published_date"], row["categories"], row["is_survey"], row["abstract_missing"]) == ("T", "x", date(2024, 5, 1), ["a", "b"], True, False)
    assert U.merge_papers(once.drop("abstract_missing"), new).collect() == once.collect()


def test_chunks(spark):
    cut = lambda text, n=3900: one(spark, C.chunks(F.col("t"), n), t=text)
    assert [len(x) for x in cut("x" * 10000)] == [3900, 3900, 2200]
    assert cut("") == [""] and cut("a\nb") == ["a\nb"]
    assert cut("ab\ncd\nefghij\nk", 6) == ["ab\ncd\n", "efghij", "\nk"]
    assert spark.createDataFrame([(None,)], "t string").select(C.chunks(F.col("t"))).first()[0] == [""]


def test_caps(spark):
    rows = spark.createDataFrame([(str(i), "t" if i < 10 else None, float(i)) for i in range(20)], "paper_id string, tag string, sim double")
    out = S.diversity_cap(rows, "tag", [F.desc("sim"), F.col("paper_id")]).collect()
    assert len(out) == 8 and [r["rank"] for r in out] == list(range(1, 9))


def test_rolling_versions(spark):
    schema = "term string, iso_week string, count int, distinct_authors int, computed_at timestamp"
    rows = spark.createDataFrame([("A  b", "2020/W27", 5, 1, None), ("a b", "2020-w27", 7, 1, None), ("a b", "2020-W30", 4, 1, None), (None, "2020-W28", 1, 1, None), ("a b", "x", 9, 1, None), ("a b", "2019-W01", 9, 1, None)], schema)
    out = {r["iso_week"]: r for r in R.rolling_totals(spark, rows).collect()}
    assert len(out) == 157
    assert (out["2020-W27"]["count"], out["2020-W30"]["total_4"], out["2020-W31"]["total_4"], out["2020-W31"]["total_13"]) == (7, 11, 4, 11)
    assert R.rolling_totals(spark, rows.limit(0)).count() == 0


def test_rolling_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randrange(40), rng.choice([None, 1, 5, 9]), date(2020, 7, 1).replace(year=2020 + rng.randrange(4))) for _ in range(300)]
    df = spark.createDataFrame(rows, "entity string, period int, amount bigint, d date").select("entity", "period", "amount", F.col("d").cast("timestamp").alias("computed_at"))
    state = R.spans(R.rolling_versions(spark, df, step_days=200), 60)
    got = {(r["entity"], p): (r["total_4"], r["total_13"]) for r in state.collect() for p in range(r["period"], r["until"] + 1)}
    latest = {}
    for e, p, a, d in sorted(rows, key=lambda r: (r[3], -1 if r[2] is None else r[2])):
        latest[e, p] = a or 0
    for e in "abc":
        for p in range(60):
            want = tuple(sum(latest.get((e, q), 0) for q in range(p - k + 1, p + 1)) for k in (4, 13))
            assert got.get((e, p), (0, 0)) == want, (e, p)


def test_rolling_state_goes_on(spark, tmp_path):
    cols = "entity string, period int, amount bigint, computed_at timestamp"
    folder = f"file://{tmp_path}/state"
    first = spark.createDataFrame([("a", 0, 5, None), ("a", 20, 2, None)], cols)
    R.rolling_versions(spark, first, folder=folder)
    late = spark.createDataFrame([("a", 1, 3)], "entity string, period int, amount bigint").withColumn("computed_at", F.lit("2021-01-01").cast("timestamp"))
    again = {r["period"]: r["total_4"] for r in R.rolling_versions(spark, late, folder=folder).collect()}
    assert (again[0], again[1], again[4], again[5]) == (5, 8, 3, 0)


def test_corrections_change_affected_periods_only(spark):
    cols = "entity string, period int, amount bigint, computed_at timestamp"
    first = spark.createDataFrame([("a", 0, 5, None), ("a", 20, 2, None)], cols)
    state = R.advance(None, first, (4, 13))
    fix = spark.createDataFrame([("a", 0, 1)], "entity string, period int, amount bigint").withColumn("computed_at", F.lit("2024-01-01").cast("timestamp"))
    after = {r["period"]: r for r in R.advance(state, fix, (4, 13)).collect()}
    assert (after[0]["total_4"], after[4]["total_4"], after[4]["total_13"], after[13]["total_13"], after[20]["total_4"]) == (1, 0, 1, 0, 2)
    old = spark.createDataFrame([("a", 0, 9)], "entity string, period int, amount bigint").withColumn("computed_at", F.lit("2020-01-01").cast("timestamp"))
    assert {r["period"]: r["total_4"] for r in R.advance(R.advance(state, fix, (4, 13)), old, (4, 13)).collect()}[0] == 1


def test_feeds(spark):
    raw = ['{"title": "A", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "publication_date": "2024-01-02"}', "{broken"]
    out = feeds.FEEDS["openalex"](spark.createDataFrame([(r,) for r in raw], "raw string")).collect()
    assert (out[0]["abstract"], out[0]["published_date"]) == ("a b a", date(2024, 1, 2)) and out[1]["title"] is None
    for name, feed in feeds.FEEDS.items():
        assert feed(spark.createDataFrame([("{}",), (None,)], "raw string")).count() == 2, name


# What each feed's record must become: (feed, record, fields).
RECORDS = [
    ("hf_daily", {"paper": {"id": "2401.00001", "title": "T", "summary": "S", "authors": [{"name": "A"}]}, "publishedAt": "2024-01-02T00:00:00Z"}, {"arxiv_id": "2401.00001", "title": "T", "abstract": "S", "authors": ["A"], "published_date": date(2024, 1, 2)}),
    ("biorxiv", {"doi": "10.1/x", "title": "T", "abstract": "S", "authors": "Doe, J.; Roe, K.", "date": "2024-01-02"}, {"doi": "10.1/x", "authors": ["Doe, J.", "Roe, K."], "published_date": date(2024, 1, 2)}),
    ("crossref", {"DOI": "10.1/x", "title": ["A", "B"], "abstract": "<jats:p>S</jats:p>", "published": {"date-parts": [[2024, 3]]}, "URL": "u"}, {"title": "A B", "abstract": "S", "published_date": date(2024, 3, 1), "url": "u"}),
    ("s2", {"paperId": "p", "title": "T", "externalIds": {"DOI": "10.1/x", "ArXiv": "2401.00001"}, "year": 2024}, {"doi": "10.1/x", "arxiv_id": "2401.00001", "published_date": date(2024, 1, 1)}),
    ("core", {"id": 7, "title": "T", "publishedDate": "bad", "depositedDate": "2024-02-03T01:00:00"}, {"source_id": "7", "published_date": date(2024, 2, 3)}),
    ("dblp", {"info": {"key": "k", "title": "T.", "authors": {"author": {"text": "A"}}, "year": "2023"}}, {"title": "T", "authors": ["A"], "published_date": date(2023, 1, 1)}),
    ("dblp", {"info": {"key": "k", "title": "T.", "authors": {"author": [{"text": "A"}, {"text": "B"}]}, "year": "2023"}}, {"authors": ["A", "B"]}),
    ("europepmc", {"id": "1", "title": "T..", "abstractText": "<h4>B</h4>S", "doi": "10.1/x", "firstPublicationDate": "2024-01-02"}, {"title": "T", "abstract": "B S", "published_date": date(2024, 1, 2)}),
    ("openreview", {"id": "o", "content": {"title": {"value": "T"}, "abstract": "S"}, "cdate": 1704153600000}, {"title": "T", "abstract": "S", "authors": [], "published_date": date(2024, 1, 2)}),
    ("medrxiv", {"doi": "10.1/x", "title": "T"}, {"source": "medrxiv", "doi": "10.1/x"}),
]


@pytest.mark.parametrize(("name", "record", "want"), RECORDS)
def test_feed_values(spark, name, record, want):
    import json

    row = feeds.FEEDS[name](spark.createDataFrame([(json.dumps(record),)], "raw string")).first()
    assert {k: row[k] for k in want} == want


def test_atom_feed(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<feed><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>A\n  title</title><summary> S </summary><published>2024-01-02T00:00:00Z</published><author><name>A B</name></author><author><name>C D</name></author></entry></feed>")
    row = feeds.arxiv_entries(spark, str(tmp_path)).first()
    assert (row["arxiv_id"], row["title"], row["abstract"], row["authors"], row["published_date"]) == ("2401.00001", "A title", "S", ["A B", "C D"], date(2024, 1, 2))


def test_keywords_and_registry(spark):
    rows = spark.createDataFrame([("Deep maps", "x"), ("Other", None)], "title string, abstract string")
    assert feeds.keyword_filter(rows, ["MAPS"]).count() == 1 and feeds.keyword_filter(rows, []).count() == 2
    assert list(feeds.enabled({"s2": True, "core": False})) == ["s2"]
    assert one(spark, X.quoted_phrases(F.col("q")), q='abs:"rare events" AND abs:"ab" OR "vision-language"') == ["rare events", "vision-language"]
    assert spark.range(1).select(X.domain_markers(F.array(F.lit('"rare events" "vision-language"')))).first()[0] == ["rare events"]
    assert one(spark, X.archive_query(F.col("q")), q="ECG signal hallucination detection") == 'abs:"ECG signal hallucination detection" OR (abs:ecg AND abs:hallucination)'


def test_warming_below_the_mark(spark):
    rows = [("a", date(2024, 3, 1), 4), ("a", date(2024, 4, 5), 6), ("b", date(2024, 3, 1), 4), ("b", date(2024, 4, 5), 4)]
    out = {r["paper_id"]: r["tier"] for r in S.citation_tiers(spark.createDataFrame(rows, "paper_id string, snapshot_date date, citation_count int"), warm=3).collect()}
    assert out == {"a": "warming", "b": "flat"}


def test_discovery_slots(spark):
    """30 phrases and 10 coinages first seen this week by two groups each: 8 coinages and 17 phrases are shown."""
    words = [f"{a}ation {b}ness" for a in ("alph", "bet", "gamm", "delt", "eps") for b in ("hard", "soft", "cold", "warm", "dark", "bright")]
    coins = [f"Net{chr(65 + i)}x" for i in range(10)]
    rows = [(f"{g}{i}", t, None, g, date(2023, 6, 28)) for g in ("g", "h") for i, t in enumerate(words + coins)]
    df = spark.createDataFrame(rows, "paper_id string, title string, abstract string, first_author_group string, announce_date date").withColumns({"muted": F.lit(False), "is_survey": F.lit(False), "first_seen_at": F.lit(None).cast("timestamp")})
    out = [r["term"] for r in T.discovery(df, [words[0]], "2023-W26").collect()]
    assert len(out) == 25 and sum(" " not in t for t in out) == 8 and words[0] not in out
