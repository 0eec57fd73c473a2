"""Small tests of the training-data operators: brute force, round trips, nulls, ties, empty tables."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("papyral.llm")
from papyral import session  # noqa: E402
from papyral.llm import components, incremental, matching, mixing, names, neighbours, reading, survivor, tokens, works  # noqa: E402

RECORD = "id string, title string, authors array<string>, doi string, arxiv_id string"


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(60)] + [(f"m{rng.randrange(80)}", f"m{rng.randrange(80)}") for _ in range(50)] + [("hub", f"h{i}") for i in range(40)] + [(None, "x"), ("y", "y")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[find(a)] = find(b)
    got = {}
    for r in components.connected_components(spark, spark.createDataFrame(edges, "u string, v string")).collect():
        got.setdefault(r["component"], set()).add(r["vertex"])
    want = {}
    for x in parent:
        want.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert components.connected_components(spark, spark.createDataFrame([], "u string, v string")).count() == 0


def test_tokens_tree_equals_whole():
    enc = tokens.encoding()
    rng = random.Random(2)
    parts = ["a", "bc ", "  ", "\n", "\n\n ", "'s", "'ll", " 12", "é", "漢字", "!!", " ", "\t", "😀", "x" * 40, " ", "'", "<|endoftext|>"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 80)))
        for leaf in (3, 20):
            assert list(tokens.encode_tree(text, enc, leaf)) == enc.encode_ordinary(text)
        assert tokens.decode_tree(enc.encode_ordinary(text), enc) == text


def test_tokens_null_and_empty(spark):
    out = tokens.encode_corpus(spark.createDataFrame([(1, None), (2, ""), (3, "hello <|endoftext|>")], "doc_id bigint, text string")).collect()
    assert [r["ids"] for r in out][:2] == [[], []] and tokens.decode_tree(out[2]["ids"]) == "hello <|endoftext|>"


def test_consensus():
    full = "a b c d e".split()
    _, away = survivor.consensus([full[:3], full, ["a", "x", "c"]], [1.0, 0.5, 0.2])
    assert away.index(min(away)) == 1
    # The longest value loses where the others outvote it: words put in between, and words of its own.
    padded, plain = "a b q r s c d e f".split(), "a b c d e f".split()
    voted, away = survivor.consensus([padded, plain, plain], [0.5, 0.4, 0.3])
    assert voted == plain and away[0] > away[1] == away[2] == 0
    voted, away = survivor.consensus(["a x y d e z".split(), "a b c d e".split(), "a b c d e".split()], [0.5, 0.4, 0.3])
    assert voted == "a b c d e z".split() and away.index(min(away)) == 1
    assert survivor.real_words("<jats:title>Abstract</jats:title><jats:p>One two...</jats:p>") == ["One", "two"]
    for nothing in (None, "", "-", "ABSTRACT: ", "(c) 2021 The Authors. All rights reserved."):
        assert survivor.real_words(nothing) == []


def test_align_is_a_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = survivor.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    long = [f"w{i}" for i in range(20_000)]
    assert len(survivor.align(long, long[:9000] + ["x"] + long[9500:])) == 19_500


def test_stand_ins_lose_to_real_abstracts(spark):
    schema = "paper_id string, source string, raw string, first_seen_at timestamp"
    message = "The publisher has not released a summary of this article and offers the whole text only to readers of its platform."
    rows = [(f"p{i}", "core", json.dumps({"abstract": message})) for i in range(3)] + [(f"p{i}", "s2", json.dumps({"abstract": f"We study case {i} of ranking."})) for i in range(2)]
    df = spark.createDataFrame([(*r, None) for r in rows], schema).withColumn("first_seen_at", F.lit("2022-01-01").cast("timestamp"))
    trust = spark.createDataFrame([("core", 1), ("s2", 2)], "source string, trust_rank int")
    out = {r["paper_id"]: r["abstract_source"] for r in survivor.survivors(df, trust).collect()}
    assert out == {"p0": "s2", "p1": "s2", "p2": ""}


def test_survivors_of_papers_with_several_sources(spark, monkeypatch):
    schema = "paper_id string, source string, raw string, first_seen_at timestamp"
    message = "The publisher has not released a summary of this article and offers the whole text only to readers of its platform."
    rows = [(f"p{i}", "core", json.dumps({"abstract": message})) for i in range(5)] + [(f"p{i}", "s2", json.dumps({"abstract": f"We study case {i} of ranking."})) for i in range(3)]
    rows += [("p0", "arxiv", json.dumps({"summary": "We study case 0 of ranking. It works."})), ("p4", "s2", json.dumps({"abstract": None})), ("p5", "s2", json.dumps({"abstract": "We rank."}))]
    df = spark.createDataFrame([(*r, None) for r in rows], schema).withColumn("first_seen_at", F.lit("2022-01-01").cast("timestamp"))
    trust = spark.createDataFrame([("core", 1), ("s2", 3), ("arxiv", 2)], "source string, trust_rank int")
    picked = lambda least: {(r["paper_id"], r["n_sources"], r["abstract_source"]) for r in survivor.survivors(df, trust, least=least).collect()}
    every = {("p0", 3, "arxiv"), ("p1", 2, "s2"), ("p2", 2, "s2"), ("p3", 1, ""), ("p4", 2, ""), ("p5", 1, "s2")}
    assert picked(1) == every
    assert picked(2) == {r for r in every if r[1] >= 2}
    monkeypatch.setattr(survivor, "MAX_SHARED", 0)
    assert picked(1) == every


def test_survivors(spark):
    schema = "paper_id string, source string, raw string, first_seen_at timestamp"
    rows = [("p", "core", '{"abstract": "one two three", "publishedDate": "03/04/2021"}'), ("p", "s2", '{"abstract": "one two three", "publicationDate": "2021-02-30"}'), ("p", "arxiv", "{broken"), ("q", "arxiv", None), (None, "arxiv", "{}")]
    df = spark.createDataFrame([(*r, None) for r in rows], schema).withColumn("first_seen_at", F.lit("2022-01-01").cast("timestamp"))
    trust = spark.createDataFrame([("s2", 1), ("core", 2)], "source string, trust_rank int")
    out = {r["paper_id"]: r for r in survivor.survivors(df, trust).collect()}
    assert (out["p"]["abstract_source"], out["p"]["date_source"], out["p"]["n_sources"]) == ("s2", "core", 3)
    assert (out["q"]["abstract_source"], out["q"]["date_source"]) == ("", "")


def test_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32))
    v = np.concatenate([c + 0.3 * rng.standard_normal((12, 32)) for c in centres] + [np.repeat(centres[:1], 9, axis=0)])
    rows = [(f"p{i:04d}", "m", [float(x) for x in v[i]], None) for i in range(len(v))] + [("bad", "m", [float("nan")] * 32, None), ("zero", "m", [0.0] * 32, None), ("none", "m", None, None), ("short", "m", [1.0], None)]
    df = spark.createDataFrame(rows, "paper_id string, model_version string, embedding array<float>, created_at timestamp")
    out = neighbours.similar_vectors(spark, df).collect()
    got = {(r["paper_id"], r["neighbour"]) for r in out}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hit = total = 0
    for i in range(480):
        best = np.sort(s[i])[-5]
        near = [j for j in np.flatnonzero(s[i] > best + 1e-6)]
        hit += sum((f"p{i:04d}", f"p{j:04d}") in got for j in near)
        total += len(near)
    assert hit / total >= 0.9
    assert not {a for a, _ in got} & {"bad", "zero", "none", "short"}
    assert neighbours.similar_vectors(spark, df.limit(0)).count() == 0


def test_titles():
    t = works.title_tokens
    same = [("(v2) RETITLED: A <i>robust</i> ViT for liver scans", "A robust transformer in liver scans"), ("Deep few-shot maps of cells…", "Deep few-shot maps of cells under noise"), ("Learning fwe-shot maps of liver cells", "Learning few-shot maps of liver cells")]
    for a, b in same:
        assert sorted(t(a)) == sorted(t(b)) or works.same_title(t(a), t(b)), (a, b)
    base = "Robust maps of liver scans under noise"
    for other in (base + ": erratum", base + " II", base + ", Part 2", base + ": a replication", base + ": reply to the comments", "Robust maps of spleen scans under noise"):
        assert sorted(t(base)) != sorted(t(other)) and not works.same_title(t(base), t(other)), other
    assert sorted(t(base + " (Part II)")) == sorted(t(base + ", part two"))
    assert t(None) == t("") == []


def test_filter_keeps_what_the_check_accepts(spark):
    rng = random.Random(5)
    words = "robust multiscale multi scale maps map liver livr scans noise deep few shot fewshot the with form teh cells #2 kernel kernels".split()
    pairs = [("robust multiscale maps liver scans", "robust multi scale maps liver scans noise"), ("map maps a b c", "a b c maps maps noise"), ("robust maps liver scans multiscale", "robust maps liver scans multi scale noise cells")]
    while len(pairs) < 20_000:
        x = [rng.choice(words) for _ in range(rng.randint(4, 8))]
        y = list(x)
        for _ in range(rng.randint(0, 5)):
            i = rng.randrange(len(y))
            w = y[i]
            k = rng.randrange(len(w) + 1)
            j = min(i + 1, len(y) - 1)
            y = rng.choice([y[:i] + [w[:k] + "x" + w[k:]] + y[i + 1 :], y[:i] + [w[:k], w[k:]] + y[i + 1 :], y[:i] + ["".join(y[i : j + 1])] + y[j + 1 :], y + [rng.choice(words)], y[:-1] or y, y[:i] + [w[:k] + w[k + 1 :]] + y[i + 1 :]])
            y = [w for w in y if w] or ["a"]
        pairs.append((" ".join(x), " ".join(y)))
    good = [(a, b) for a, b in pairs if works.same_title(a.split(), b.split()) or works.same_title(b.split(), a.split())]
    kept = spark.createDataFrame(good, "a string, b string").where(works.worth_checking(F.col("a"), F.col("b")) & works.worth_checking(F.col("b"), F.col("a")))
    assert len(good) > 1000 and kept.count() == len(good)


def test_letters_keep_what_the_check_accepts_and_tell_titles_of_common_words_apart(spark):
    rng = random.Random(7)
    words = "robust multiscale multi scale maps map liver livr scans noise deep few shot fewshot the with form teh cells #2 kernel kernels 3d überall".split()
    pairs = [("robust multiscale maps liver scans", "robust multi scale maps liver scans noise"), ("map maps a b c", "a b c maps maps noise"), ("map zap deep scans", "maps maps deep scans")]
    while len(pairs) < 20_000:
        x = [rng.choice(words) for _ in range(rng.randint(3, 8))]
        y = rng.sample(x, len(x))
        for _ in range(rng.randint(0, 5)):
            i, w = (i := rng.randrange(len(y))), y[i]
            k, c = rng.randrange(len(w) + 1), rng.choice("abdefkz")
            y = rng.choice([y[:i] + [w[:k] + c + w[k:]] + y[i + 1 :], y[:i] + [w[:k], w[k:]] + y[i + 1 :], y[:i] + ["".join(y[i : i + 2])] + y[i + 2 :], y + [rng.choice(words)], y[:-1] or y, y[:i] + [w[:k] + w[k + 1 :]] + y[i + 1 :], y[:i] + [w[:k] + w[k : k + 2][::-1] + w[k + 2 :]] + y[i + 1 :]])
            y = [w for w in y if w] or ["a"]
        pairs.append((" ".join(x), " ".join(y)))
    good = [(a.split(), b.split()) for a, b in pairs if sorted(a.split()) == sorted(b.split()) or works.same_title(a.split(), b.split())]
    told = lambda pairs: spark.createDataFrame(list(zip(*(works.letter_bits(list(side)).tolist() for side in zip(*pairs)))), "a bigint, b bigint").where(works.like_letters("a", "b")).count()
    assert len(good) > 1000 and told(good) == len(good)
    # Titles of 200 common words that share two: few of the pairs are left.
    common = ["".join(rng.choice("etaoinsrhldcumfpgwyb") for _ in range(rng.randint(4, 10))) for _ in range(200)]
    others = [(t[:7], [*t[:2], *t[7:]]) for t in (rng.sample(common, 12) for _ in range(2000))]
    assert told(others) < 400
    assert works.letter_bits([]).size == 0


RAW = "raw_id bigint, batch_id int, title string, authors array<string>, doi string, arxiv_id string"
PAPERS = "paper_id string, title string, authors array<string>, doi string, arxiv_id string"


def known(spark, raw, papers=(), deliveries=None):
    rows, accepted = spark.createDataFrame(list(raw), RAW), spark.createDataFrame(list(papers), PAPERS)
    return {r["raw_id"]: r["known_as"] for r in incremental.known_works(spark, rows, accepted, deliveries).collect()}


def test_known_works(spark):
    papers = [("doi:10.1/a", "Robust maps of liver scans under noise", ["Ann Lee"], "10.1000/a", None), ("x", None, None, None, None)]
    raw = [(1, 1, "Robust maps of livver scans under noise", ["A. Lee"], None, None), (2, 1, "Other title of some kind here", ["Bo Kim"], "n/a", None), (3, 2, "Other title of some kind here", ["Bo Kim"], "-", None), (4, 2, None, None, "https://doi.org/10.1000%2FA", None), (5, 2, None, None, None, None), (6, None, "", [], "n/a", None)]
    want = {1: "doi:10.1/a", 3: "raw:2", 4: "doi:10.1/a"}
    for deliveries in (None, [[1, 2, None]]):
        assert known(spark, raw, papers, deliveries) == want
    assert known(spark, [], papers) == {}


def test_any_split_gives_the_same_rows(spark):
    rng = random.Random(8)
    words = "robust maps liver scans noise deep few shot kernels cells retina graphs".split()
    people = ["Ann Leeming", "Bo Kimura", "Cy Oduya", "Di Petrov", "Eve Sandoval"]
    # The first three: a title without authors, the same with an author, a slip with that author.
    raw = [(1, 1, "Robust maps of liver scans under noise", [], None, None), (2, 2, "Robust maps of liver scans under noise", ["Ann Leeming"], None, None), (3, 3, "Robust maps of liever scans under noise", ["Ann Leeming"], None, None)]
    for i in range(4, 90):
        title = " ".join(rng.sample(words, rng.choice([3, 5, 6]))) if rng.random() < 0.5 else raw[rng.randrange(len(raw))][2]
        if rng.random() < 0.3:
            k = rng.randrange(len(title) - 1)
            title = title[:k] + rng.choice("abcxyz") + title[k + 1 :]
        raw.append((i, 1 + i // 4, title, rng.sample(people, rng.randint(0, 2)), f"10.1000/{rng.randrange(40)}" if rng.random() < 0.2 else None, None))
    batches = sorted({r[1] for r in raw})
    one = known(spark, raw, deliveries=[batches])
    assert one[2] == "raw:1" and one[3] == "raw:1"
    assert known(spark, raw, deliveries=[batches[:2], batches[2:]]) == one
    assert len(batches) == 23 and known(spark, raw) == one


def test_works_after_each_delivery(spark):
    """Asked for works after every delivery, the index contracts what is new only, and ends with the same works."""
    title = "Robust maps of liver scans under noise"
    rows = [[("a", title, ["Ann Leeming"], None, None), ("b", "Deep kernels of retina cells", ["Bo Kimura"], "10.1000/b", None)], [("c", title.replace("liver", "livver"), ["Ann Leeming"], None, None), ("d", title, ["Cy Oduya"], None, None)], [("e", "Kernels", ["Bo Kimura"], "10.1000/B", None)]]
    ends = []
    for every in (True, False):
        index, features = incremental.FingerprintIndex(spark, buckets=2), []
        for part in rows:
            features.append(index.scratch.save(works.work_features(spark.createDataFrame(part, RECORD))))
            index.append(features[-1])
            if every:
                index.works()
        works_of = {r["vertex"]: r["work"] for r in index.works().collect()}
        groups = {}
        for f in features:
            for r in index.vertices(f).collect():
                groups.setdefault(works_of.get(r["vertex"], r["vertex"]), set()).add(r["id"])
        ends.append(sorted(map(sorted, groups.values())))
    assert ends[0] == ends[1] == [["a", "c"], ["b", "e"], ["d"]]


def test_index_is_opened_again(spark, tmp_path):
    title, folder = "Robust maps of liver scans under noise", f"file://{tmp_path}/index"
    first = incremental.FingerprintIndex(spark, folder, buckets=2)
    first.append(first.scratch.save(works.work_features(spark.createDataFrame([("a", title, ["Ann Leeming"], None, None)], RECORD))))
    again = incremental.FingerprintIndex(spark, folder, buckets=2)
    assert again.n == 1
    again.append(again.scratch.save(works.work_features(spark.createDataFrame([("b", title.replace("noise", "nosie"), ["Ann Leeming"], None, None)], RECORD))))
    assert again.works().count() == 2


def test_other_people_make_another_work(spark):
    title = "Robust maps of liver scans under noise"
    raw = [(1, 1, title, ["Ann Leeming"], "10.1000/a", None), (2, 1, title, ["Bo Kimura"], "10.1000/b", None), (3, 2, title, ["Kimura, B."], None, None), (4, 2, title, ["Ann Leming"], None, None), (5, 2, title, ["Ann Leeming", "Cy Oduya"], None, None), (6, 3, title, ["Oduya, C."], None, None)]
    assert known(spark, raw) == {3: "raw:2", 4: "raw:1", 5: "raw:1", 6: "raw:1"}


def test_fingerprints_tell_slips_from_other_titles():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 10))) for _ in range(500)]
    titles = [rng.sample(words, 8) for _ in range(300)]
    slips = [[w if i else w[:2] + "q" + w[2:] for i, w in enumerate(t)] for t in titles]
    a, _ = works.fingerprints(titles)
    b, _ = works.fingerprints(slips)
    bits = lambda x, y: [bin((int(p) ^ int(q)) & works.MASK).count("1") for p, q in zip(x, y)]
    assert sum(d <= works.MAX_BITS for d in bits(a, b)) >= 290
    assert sum(d <= works.MAX_BITS for d in bits(a[1:], a)) <= 30


def slip_in_one_block(title):
    """The title with a letter added to one word, such that three blocks of its fingerprint stay as they are."""
    own, _ = works.fingerprints([works.title_tokens(title)])
    for k in range(2, len(title)):
        slipped = title[:k] + "q" + title[k:]
        made, _ = works.fingerprints([works.title_tokens(slipped)])
        parts = [(int(own[0]) ^ int(made[0])) >> (16 * b) & 0xFFFF for b in range(4)]
        if sum(p == 0 for p in parts) == 3 and title[k - 1] != " " != title[k]:
            return slipped
    raise AssertionError("no such slip")


def test_matching(spark):
    papers = spark.createDataFrame([("p1", "Robust maps of liver scans under noise", ["Ann Leeming"], None, None), ("p2", "Robust maps of liver scans under noise: erratum", ["Ann Leeming"], None, None)], "paper_id string, title string, authors array<string>, doi string, arxiv_id string").withColumn("published_date", F.lit(None).cast("date"))
    records = spark.createDataFrame([(1, "ROBUST MAPS OF LIVER SCANS UNDER NOISE.", ["A. Leeming"]), (2, slip_in_one_block("Robust maps of liver scans under noise"), []), (3, None, None)], "record_id bigint, title string, authors array<string>").withColumn("published_date", F.lit(None).cast("date"))
    labels = spark.createDataFrame([("p1", "p2", "different", None)], "left_key string, right_key string, verdict string, decided_at timestamp")
    out = matching.match_records(spark, records, papers, labels).collect()
    assert {(r["record_id"], r["paper_id"], r["rule"]) for r in out} == {(1, "p1", "title and author"), (2, "p1", "three title blocks, a date missing")}
    assert all(0 < r["confidence"] < 1 for r in out)


def test_collision_curve():
    for length in range(4, 20):
        rows, bands = names.banding(length)
        assert rows >= 2
        grams = length + names.Q - 1
        j = max(grams - names.Q - 1, 1) / (grams + names.Q + 1)
        assert 1 - (1 - j**rows) ** bands >= names.RECALL and (bands <= names.MOST or rows == 2)


def test_given_names_joined_or_broadcast(spark, monkeypatch):
    people = spark.createDataFrame([(["Keira Tomo", "Keira Bado", "Keira Mun", "Tomo Keira", "Keira Sato", "Keira Lund"],)], "authors array<string>")
    one = {(r["name"], r["cluster"]) for r in names.name_clusters(spark, people).collect()}
    monkeypatch.setattr(names, "SMALL_LIST", 0)
    assert {(r["name"], r["cluster"]) for r in names.name_clusters(spark, people).collect()} == one


def test_names(spark):
    people = ["Francesca A. Pegigevik", "Francesca Pegigevik", "Pegigevik, Francesca", "PEGIGEVIK Francesca", "Dr. Francesca Pegigevik", "F. Pegigevik", "Franca Pegigevik", "Francesca Pegigevvik"]
    other = ["Francesca Kidrebilund", "Bebripol Imaging Lab", "Bebripol Imaging Laboratory", "et al.", "", None, "Keira Tomo", "Keira Bado", "Keira Mun", "Francesca Oro", "Francesca Ulm", "Francesca Ino", "Keira Sato", "Keira Lund"]
    df = spark.createDataFrame([([x],) for x in people + other] + [(None,), ([],)], "authors array<string>")
    by = {}
    for r in names.name_clusters(spark, df).collect():
        by.setdefault(r["cluster"], set()).add(r["name"])
    assert set(people) in list(by.values())
    assert {"Bebripol Imaging Lab", "Bebripol Imaging Laboratory"} in list(by.values())


def test_mixture(spark):
    docs = [(i, "word " * (1 + i % 30), "a" if i % 3 else "B ") for i in range(600)] + [(1000, None, "a"), (1001, "", "b"), (1002, "x", None)]
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.5, 4), ("none", 0.2, 1)], "source string, target_share double, max_repeats int")
    used, shares = mixing.mixture(spark, spark.createDataFrame(docs, "doc_id bigint, text string, source string"), targets)
    got = {r["source"]: r["share"] for r in shares.collect()}
    assert abs(got["a"] - 0.375) < 0.01 and abs(got["b"] - 0.625) < 0.01 and got["none"] == 0
    assert {r["source"]: r["m"] for r in used.groupBy("source").agg(F.max("copies").alias("m")).collect()}["a"] <= 2


def test_reading(spark):
    easy, hard = "The cat sat on the mat. It was a big red cat. " * 6, "The multidimensional characterization of heterogeneous neurodegeneration necessitates interdisciplinary methodologies, notwithstanding the fact that computational approximations deteriorate. " * 4
    docs = spark.createDataFrame([(1, easy), (2, hard), (3, None), (4, ""), (5, "Das ist ein Test und nicht mehr als das. " * 20)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, reader string, band int")
    assert {r["doc_id"]: r["band"] for r in reading.reading_bands(docs, none).collect()} == {1: 1, 2: 5}
    assert [reading.syllables(w) for w in ("cat", "table", "make", "banana", "readability")] == [1, 2, 1, 3, 5]


def test_extra_columns_do_not_clash(spark):
    pairs = spark.createDataFrame([("a", "b", "Same ", 1.0, "x")], "left_key string, right_key string, verdict string, u double, v string").withColumn("decided_at", F.lit(None).cast("timestamp"))
    papers = spark.createDataFrame([("a", None, None, 1), ("b", "n/a", "", 2), ("c", "-", "none", 3)], "canonical_key string, doi string, arxiv_id string, component int")
    assert {tuple(r) for r in components.paper_groups(spark, papers, pairs).collect()} == {("a", "a"), ("b", "a")}


def test_long_preprint_numbers_stay_apart(spark):
    papers = spark.createDataFrame([("a", "2306.105261v2"), ("b", "arXiv:2306.105261"), ("c", "2306.105262"), ("d", "2306.10526"), ("e", "https://x.example/abs/2306.105262v1")], "canonical_key string, arxiv_id string").withColumn("doi", F.lit(None).cast("string"))
    pairs = spark.createDataFrame([], "left_key string, right_key string, verdict string, decided_at timestamp")
    assert {tuple(r) for r in components.paper_groups(spark, papers, pairs).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("e", "c")}


def test_name_joins_are_not_broadcast(spark, monkeypatch, tmp_path):
    """No table of names is sent through the driver, however small the planner takes it to be."""
    plans = []

    class Seen(names.Scratch):
        def save(self, df, *args, **kwargs):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().save(df, *args, **kwargs)

    monkeypatch.setattr(names, "Scratch", Seen)
    spark.createDataFrame([(["Keira Lundqvist", "Keira Lundqvits"],), (["Keira Lundqvist"],)], "authors array<string>").write.parquet(f"{tmp_path}/raw_papers.parquet")
    out = names.p6_found(spark, str(tmp_path))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {tuple(r) for r in out.collect()} == {("Keira Lundqvist", "Keira Lundqvits")}
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("BroadcastHashJoin" in p for p in plans)


def test_similar_words_need_no_table_of_edits(monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.choice("aeln") for _ in range(rng.choice([1, 2, 3, 5, 9, 18, 19, 20, 24, 50]))) for _ in range(60)]
    slipped = [w[:k] + rng.choice(["", "x", w[k : k + 2][::-1]]) + w[k + rng.randint(0, 2) :] for w in words for k in (0, len(w) // 2, max(len(w) - 2, 0))]
    pairs = [(a, b) for a in words + slipped if a for b in words + slipped if b]
    for a, b in pairs:
        like = names.monge_elkan([a], [b])
        assert names.similar(a, b) == (like if like >= names.SIMILAR else 0), (a, b)
    assert sum(names.similar(a, b) > 0 and a != b for a, b in pairs) > 200
    # Names of under nineteen letters are clustered without it.
    counted, edits = [], names._edits
    monkeypatch.setattr(names, "_edits", lambda x, y: counted.append((x, y)) or edits(x, y))
    given = ["francesca", "fransesca", "felicitas", "frederika", "fernanda", "filippa"]
    assert names.star_clusters([(g, 9 - i, "p", "oro", g, "") for i, g in enumerate(given)], "oro") == [0, 0, 1, 2, 3, 4]
    assert set(counted) <= {("fransesca", "francesca")}


def test_groups_of_names_may_cross_batches(spark, monkeypatch):
    """Groups are told apart in the sorted rows, not sent to Python one by one; where a batch ends makes no difference."""
    people = [f"{g} {f}" for f in ("Lundqvist", "Pegigevik", "Orosco") for g in ("Keira", "Kiera", "K.", "Tomo", "Karl", "Keira A.")] + ["Bebripol Imaging Lab", "Bebripol Imaging Laboratory"]
    df = spark.createDataFrame([([x],) for x in people], "authors array<string>")

    def grouped():
        clusters = names.name_clusters(spark, df)
        assert "FlatMapGroups" not in clusters._jdf.queryExecution().executedPlan().toString()
        by = {}
        for r in clusters.collect():
            by.setdefault(r["cluster"], set()).add((r["name"], r["n"]))
        return sorted(map(sorted, by.values()))

    whole = grouped()
    assert sum(map(len, whole)) == len(people) and max(map(len, whole)) >= 4
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert grouped() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_later_deliveries_compile_nothing(spark, monkeypatch):
    """The generated code of one delivery serves the next: no text of it holds the delivery's number."""
    codes = []

    class Seen(incremental.Buckets):
        def append(self, df, placed=False):
            made = df._jdf.queryExecution().debug().codegenToSeq()
            codes[-1].extend(made.apply(i)._2() for i in range(made.size()))
            super().append(df, placed)

    monkeypatch.setattr(incremental, "Buckets", Seen)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        index = incremental.FingerprintIndex(spark, buckets=2)
        for i in range(3):
            codes.append([])
            index.append(index.scratch.save(works.work_features(spark.createDataFrame([(f"p{i}", f"Robust maps of cell{i} scans", ["Ann Leeming"], f"10.1000/{i}", None)], RECORD))))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert index.n == 3 and len(codes[1]) > 10 and codes[1] == codes[2]


def listed(spark):
    """Listings of files that Spark's own cache holds on the driver."""
    named = spark.sparkContext._jvm.java.lang.Class.forName

    def field(holder, of, kind):
        found = next(f for f in of.getDeclaredFields() if f.getType().getSimpleName() == kind)
        found.setAccessible(True)
        return found.get(holder)

    package = "org.apache.spark.sql.execution.datasources"
    whole = field(field(None, named(f"{package}.FileStatusCache$"), "FileStatusCache$"), named(f"{package}.FileStatusCache$"), "SharedInMemoryCache")
    if whole is None:  # nothing listed yet
        return 0
    none = spark.sparkContext._gateway.new_array
    size = named("org.sparkproject.guava.cache.Cache").getMethod("size", none(spark.sparkContext._jvm.java.lang.Class, 0))
    return size.invoke(field(whole, whole.getClass(), "Cache"), none(spark.sparkContext._jvm.java.lang.Object, 0))


def test_tables_that_grow_leave_no_listings_on_the_driver(spark, tmp_path):
    """Every read after an append left a listing of all files of the table in Spark's cache, for the session's life."""
    spark.read.parquet(incremental.Scratch(spark, "test").save(spark.range(1))._papyral_path).count()
    before = listed(spark)
    assert before
    grown = incremental.Buckets(spark, f"file://{tmp_path}/grown", "key bigint, v bigint", "key", 2)
    for i in range(3):
        grown.append(spark.range(i, i + 10).select(F.col("id").alias("key"), F.col("id").alias("v")))
        assert grown.read().join(grown.read().where("v > 3"), "key").count() and grown.read().count() == 10 * (i + 1)
    grown.drop()
    assert listed(spark) == before and spark.conf.get("spark.sql.hive.filesourcePartitionFileCacheSize", None) is None


def test_known_works_leaves_no_index_behind(spark, monkeypatch):
    """The result is read without the index, which is deleted; freed memory goes back after each delivery."""
    trimmed, tables = [], {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(incremental, "trim_driver", lambda s: trimmed.append(session.trim_driver(s)))
    title = "Robust maps of liver scans under noise"
    raw = [(1, 1, title, ["Ann Leeming"], None, None), (2, 2, title, ["Cy Oduya"], None, None), (3, 3, title.replace("liver", "livver"), ["Ann Leeming"], None, None), (4, 3, title, ["Cy Oduya"], None, None)]
    assert known(spark, raw) == {3: "raw:1", 4: "raw:2"}
    assert {t.name for t in spark.catalog.listTables()} == tables and len(trimmed) == 3
