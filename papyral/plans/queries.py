"""The queries of the core operators over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyral.functions import text as X
from papyral.functions import vectors as V
from papyral.functions import weeks as K
from papyral.functions import wordlists as L
from papyral.operators import clusters as G
from papyral.operators import lifecycle as C
from papyral.operators import records as D
from papyral.operators import rolling as R
from papyral.operators import signals as S
from papyral.operators import trends as T
from papyral.operators import upsert as U
from papyral.session import Scratch, table
from papyral.streaming.ingest import weekly

AS_OF, CURRENT = "2023-06-30", "2023-W26"
WEIGHTS = {"self-supervised": 1.0, "world-model": 1.0, "lung scans": 0.8, "priors": 0.5, "few-shot": 1.0, "low dose exposure": 0.7, "transformer": 1.0, "retrieval": 0.6, "planner": 0.9, "dropout": 0.4, "ultrasound": 0.8, "coarse-to-fine": 0.7}
TERMS = sorted(WEIGHTS)
PHRASES = ["fundus photographs", "discharge notes", "rare events", "kitchen demonstrations", "knee scans"]
MODEL, DIM, ANCHORS = "vm-base-96", 96, 5
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return add


def as_of():
    return F.lit(AS_OF).cast("date")


def papers(s: SparkSession, d: str) -> DataFrame:
    """Rows of papers, exact repeats once: one key is shuffled with the columns that a query asks for, no more."""
    return table(s, d, "papers").dropDuplicates(["paper_id"])


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _border(t: str) -> str:
    return r"(^|[^\p{L}\p{N}_])" + t.replace("+", r"\+") + r"($|[^\p{L}\p{N}_])"


def _terms_sql(terms=TERMS) -> str:
    return "terms AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{_border(t)}', {WEIGHTS.get(t, 1.0)})" for t in terms) + ") AS v(term, pat, weight))"


def _match(source: str, columns: str, low: str, terms=TERMS) -> str:
    """One branch a term, as a constant pattern is compiled once."""
    return " UNION ALL ".join(f"SELECT {columns}, '{t}' AS term, {WEIGHTS.get(t, 1.0)} AS weight FROM {source} WHERE regexp_matches({low}, '{_border(t)}')" for t in terms)


P = "p AS (SELECT DISTINCT * FROM papers), e AS (SELECT *, strftime(coalesce(announce_date, published_date), '%G-W%V') AS iso_week, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS low FROM p WHERE NOT coalesce(muted, false) AND NOT coalesce(is_survey, false) AND coalesce(announce_date, published_date) IS NOT NULL)"
HITS = P + ", " + _terms_sql() + ", hits AS MATERIALIZED (" + _match("e", "paper_id, iso_week, first_author_group, coalesce(announce_date, published_date) AS day", "low") + ")"
COUNTS = HITS + ", counts AS (SELECT term, iso_week, count(*) AS count, count(DISTINCT first_author_group) AS distinct_authors FROM hits GROUP BY ALL)"
_BASE = ", ".join(f"'{w}'" for w in K.plan_weeks(CURRENT, 6)[:-1])
MOMENTUM = COUNTS + f", mom AS (SELECT terms.term, coalesce(sum(count) FILTER (WHERE iso_week = '{CURRENT}'), 0)::BIGINT AS current, coalesce(sum(count) FILTER (WHERE iso_week IN ({_BASE})), 0) / 6.0::DOUBLE AS baseline FROM terms LEFT JOIN counts USING (term) GROUP BY terms.term), momentum AS MATERIALIZED (SELECT term, current, round(baseline, 3) AS baseline, round(current - baseline, 3) AS momentum FROM mom)"


def _hits(s, d):
    return T.hits(papers(s, d), TERMS)


def _counts(s, d):
    return T.term_counts(_hits(s, d))


@query("WITH " + HITS + " SELECT paper_id, term, iso_week FROM hits")
def term_hits(s, d):
    return _hits(s, d).select("paper_id", "term", "iso_week")


@query("WITH " + COUNTS + " SELECT * FROM counts")
def term_counts(s, d):
    return _counts(s, d)


@query("WITH " + P + ", c AS (SELECT iso_week, unnest(categories) AS category FROM e) SELECT iso_week, category, count(*) AS count FROM c GROUP BY ALL")
def category_volume(s, d):
    return T.category_volume(papers(s, d))


@query("WITH " + COUNTS + " SELECT term, max(iso_week) AS last_seen_iso_week FROM counts GROUP BY term")
def last_seen_week(s, d):
    return T.last_seen(_counts(s, d))


@query("WITH " + MOMENTUM + " SELECT term, current, baseline, momentum FROM momentum")
def momentum(s, d):
    return T.momentum(_counts(s, d), TERMS, CURRENT)


@query("WITH " + MOMENTUM + " SELECT term, current, baseline, momentum FROM momentum WHERE momentum > 0 OR (SELECT max(momentum) FROM momentum) <= 0 ORDER BY momentum DESC, current DESC, term LIMIT 8")
def rising_terms(s, d):
    return T.rising(T.momentum(_counts(s, d), TERMS, CURRENT))


@query("WITH " + COUNTS + ", spine AS (SELECT term, w, strftime(DATE '2020-06-29' + 7 * w::INTEGER, '%G-W%V') AS iso_week FROM (SELECT DISTINCT term FROM counts), range(0, 157) AS r(w)), f AS (SELECT term, w, iso_week, coalesce(count, 0) AS count FROM spine LEFT JOIN counts USING (term, iso_week)), b AS (SELECT *, coalesce(sum(count) OVER (PARTITION BY term ORDER BY w RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) / 6.0::DOUBLE AS baseline FROM f) SELECT term, iso_week, count, round(baseline, 3) AS baseline, round(count - baseline, 3) AS momentum FROM b")
def momentum_all_weeks(s, d):
    return T.momentum_all_weeks(_counts(s, d), "2020-W27", "2023-W26")


def _weeks(ws):
    return ", ".join(f"'{w}'" for w in ws)


_SIX = K.plan_weeks(CURRENT, 5)


@query("WITH " + HITS + f", g AS (SELECT term, count(DISTINCT first_author_group) FILTER (WHERE iso_week IN ({_weeks(_SIX[3:])})) AS k, count(DISTINCT first_author_group) FILTER (WHERE iso_week IN ({_weeks(_SIX[:3])})) AS p FROM hits GROUP BY term) SELECT terms.term, coalesce(k, 0) AS distinct_groups, coalesce(p, 0) AS prev_distinct_groups, coalesce(k, 0) >= 3 AND coalesce(k, 0) > coalesce(p, 0) AS bursting FROM terms LEFT JOIN g USING (term)")
def bursts(s, d):
    return T.bursts(_hits(s, d), TERMS, CURRENT)


@query("WITH " + HITS + ", r AS (SELECT DISTINCT term, first_author_group AS g, date_trunc('week', day)::DATE AS m FROM hits WHERE first_author_group IS NOT NULL) SELECT term, m + 7 * k::INTEGER AS monday, count(DISTINCT g) AS distinct_groups FROM r, range(0, 3) AS x(k) GROUP BY ALL")
def burst_windows(s, d):
    rows = X.term_hits(T.paper_text(T.eligible(papers(s, d))).select("first_author_group", F.coalesce("announce_date", "published_date").alias("day"), "text"), TERMS)
    return T.all_bursts(rows)


_BARRED = _list([*L.STOPWORDS, *L.REPORTING_WORDS])


def _grams_sql(source: str, text: str, keep: str) -> str:
    """CTEs: gw (words), gk (kept), grams(keep..., gram) distinct a row: phrases and coinages."""
    return (
        f"gw AS (SELECT {keep}, {text} AS t, list_filter(string_split(trim(regexp_replace(lower({text}), '[\\s\\x0B\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM {source}), "
        f"gk AS (SELECT *, len(ws) < 12 OR len(list_filter(ws, lambda w: list_contains({_list(L.ENGLISH_MARKERS)}, w)))::DOUBLE / len(ws) >= 0.08 AS english, list_filter(ws, lambda w: regexp_full_match(w, '\\p{{L}}+') OR contains(w, '-')) AS kept FROM gw), "
        f"gb AS (SELECT *, CASE WHEN english THEN list_filter(list_distinct(list_transform(list_filter(range(1, len(kept)), lambda i: NOT list_contains({_BARRED}, kept[i]) AND NOT list_contains({_BARRED}, kept[i + 1])), lambda i: kept[i] || ' ' || kept[i + 1])), lambda g: length(g) >= 8 AND NOT list_contains({_list(L.STOP_BIGRAMS)}, g)) ELSE [] END AS bigrams, "
        f"list_filter(list_distinct(list_transform(list_filter(regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,6}}|[A-Z][a-z]+[A-Z][A-Za-z0-9]*')), lambda w: lower(w))), lambda w: length(w) >= 3 AND NOT list_contains({_list(L.STOP_ACRONYMS)}, w)) AS acronyms FROM gk)"
    )


_DOC_GRAMS = _grams_sql("documents", "coalesce(text, '')", "doc_id")


@query("WITH " + _DOC_GRAMS + " SELECT g AS gram, count(*) AS n FROM (SELECT unnest(bigrams) AS g FROM gb) GROUP BY g")
def bigrams_df(s, d):
    return table(s, d, "documents").select(F.explode(X.bigrams(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("WITH " + _DOC_GRAMS + " SELECT g AS gram, count(*) AS n FROM (SELECT unnest(acronyms) AS g FROM gb) GROUP BY g")
def acronyms_df(s, d):
    return table(s, d, "documents").select(F.explode(X.acronyms(F.col("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("WITH " + _DOC_GRAMS + " SELECT doc_id, english FROM gb")
def english_guard(s, d):
    return table(s, d, "documents").select("doc_id", X.looks_like_english(F.col("text")).alias("english"))


_SURVEY = r"'(?i)(^|[^\p{L}\p{N}_])(survey|review|overview|comprehensive)($|[^\p{L}\p{N}_])'"


@query(f"SELECT raw_id, regexp_matches(coalesce(title, ''), {_SURVEY}) OR regexp_matches(substr(coalesce(abstract, ''), 1, 200), {_SURVEY}) AS is_survey FROM raw_papers")
def survey_flag(s, d):
    return table(s, d, "raw_papers").select("raw_id", X.looks_like_survey(F.col("title"), F.col("abstract")).alias("is_survey"))


_FIRST, _LAST = K.plan_days(CURRENT, 8)
_DISCOVERY = (
    "WITH p AS (SELECT DISTINCT * FROM papers), u AS (SELECT *, coalesce(announce_date, first_seen_at::DATE) AS day FROM p WHERE NOT coalesce(muted, false) AND NOT coalesce(is_survey, false)), "
    f"v AS (SELECT *, strftime(day, '%G-W%V') AS iso_week, coalesce(first_author_group, 'anon:' || substr(title, 1, 40)) AS g FROM u WHERE day BETWEEN DATE '{_FIRST}' AND DATE '{_LAST}'), "
    + _grams_sql("v", "coalesce(title, '') || ' ' || coalesce(abstract, '')", "iso_week, g")
    + f", f AS (SELECT DISTINCT iso_week, g, unnest(list_distinct(list_concat(bigrams, acronyms))) AS gram FROM gb), k AS (SELECT gram, count(*) FILTER (WHERE iso_week = '{CURRENT}') AS cur, count(*) FILTER (WHERE iso_week <> '{CURRENT}') AS bef FROM f WHERE NOT list_contains({_list(TERMS)}, gram) GROUP BY gram), "
    "t AS (SELECT gram AS term, CASE WHEN bef = 0 AND cur >= 2 THEN 'first_appearance' WHEN bef > 0 AND cur >= 3 AND cur > bef / 8.0 THEN 'bursting' END AS tier, cur AS current_count, CASE WHEN bef > 0 THEN round_even(bef / 8.0::DOUBLE, 2) ELSE 0.0 END AS baseline_count, CASE WHEN bef > 0 THEN round_even(cur - bef / 8.0::DOUBLE, 2) ELSE cur END::DOUBLE AS delta FROM k), "
    "r AS (SELECT *, NOT contains(term, ' ') AS c, row_number() OVER (PARTITION BY tier, NOT contains(term, ' ') ORDER BY delta DESC, term) AS rn FROM t WHERE tier IS NOT NULL), "
    "x AS (SELECT *, count(*) FILTER (WHERE c AND rn <= 8) OVER (PARTITION BY tier) AS taken FROM r) SELECT term, tier, current_count, baseline_count, delta FROM x WHERE CASE WHEN c THEN rn <= 8 ELSE rn <= 25 - taken END"
)


@query(_DISCOVERY)
def discovery(s, d):
    return T.discovery(papers(s, d), TERMS, CURRENT)


_FOLD = "regexp_replace(strip_accents(replace(replace(replace({0}, chr(160), ' '), 'ﬁ', 'fi'), 'ﬂ', 'fl')), '[^\\x00-\\x7F]', '', 'g')"


def _fold(c: str) -> str:
    return _FOLD.format(c)


def _surname_sql(name: str) -> str:
    clean = f"lower({_fold(f"trim(regexp_replace({name}, '{X.WHITE}', ' ', 'g'))")})"
    return f"regexp_replace(CASE WHEN contains({clean}, ',') THEN split_part({clean}, ',', 1) ELSE split_part({clean}, ' ', -1) END, '[^a-z]', '', 'g')"


_KEY = (
    "coalesce('doi:' || nullif(regexp_replace(lower(trim(doi)), '^https?://doi\\.org/', ''), ''), 'arxiv:' || nullif(regexp_replace(lower(trim(arxiv_id)), 'v\\d+$', ''), ''), "
    f"'hash:' || substr(sha1(concat_ws('|', coalesce(trim(regexp_replace(lower({_fold('title')}), '[^a-z0-9]+', ' ', 'g')), ''), coalesce({_surname_sql('authors[1]')}, ''), coalesce(year(coalesce(published_date, announce_date))::VARCHAR, ''))), 1, 16))"
)
_BUILT = (
    f"built AS (SELECT {_KEY} AS paper_id, trim(regexp_replace(coalesce(title, ''), '[\\s\\x0B\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS title, CASE WHEN abstract <> '' THEN trim(regexp_replace(abstract, '[\\s\\x0B\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')) END AS abstract, nullif({_surname_sql('authors[1]')}, '') AS first_author_group, nullif(trim(doi), '') AS doi, nullif(trim(arxiv_id), '') AS arxiv_id, published_date, announce_date, categories, "
    f"regexp_matches(coalesce(title, ''), {_SURVEY}) OR regexp_matches(substr(coalesce(abstract, ''), 1, 200), {_SURVEY}) AS is_survey, raw_id AS seq, source FROM raw_papers), last AS (SELECT * FROM built QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY seq DESC) = 1)"
)


@query("WITH " + _BUILT + " SELECT seq AS raw_id, paper_id, first_author_group FROM built")
def canonical_keys(s, d):
    return U.built_rows(table(s, d, "raw_papers")).select(F.col("seq").alias("raw_id"), "paper_id", "first_author_group")


@query("WITH " + _BUILT + " SELECT paper_id, seq AS raw_id FROM last")
def dedup_last_wins(s, d):
    return U.last_wins(U.built_rows(table(s, d, "raw_papers")), ["paper_id"], "seq").select("paper_id", F.col("seq").alias("raw_id"))


_CATS = "array_to_string(list_sort(list_distinct(list_concat(coalesce(o.categories, []), coalesce(n.categories, [])))), ',')"


@query(
    "WITH "
    + _BUILT
    + f", o AS (SELECT DISTINCT * FROM papers) SELECT coalesce(o.paper_id, n.paper_id) AS paper_id, CASE WHEN o.paper_id IS NULL THEN n.title ELSE o.title END AS title, coalesce(o.abstract, n.abstract) AS abstract, coalesce(o.doi, n.doi) AS doi, coalesce(o.arxiv_id, n.arxiv_id) AS arxiv_id, least(o.published_date, n.published_date) AS published_date, least(o.announce_date, n.announce_date) AS announce_date, CASE WHEN o.paper_id IS NULL THEN array_to_string(n.categories, ',') WHEN n.paper_id IS NULL THEN array_to_string(o.categories, ',') ELSE {_CATS} END AS categories, coalesce(o.is_survey, false) OR coalesce(n.is_survey, false) AS is_survey, coalesce(o.abstract, n.abstract) IS NULL AS abstract_missing FROM o FULL JOIN last n ON o.paper_id = n.paper_id"
)
def merge_papers(s, d):
    old = papers(s, d).select("paper_id", "title", "abstract", "doi", "arxiv_id", "first_author_group", "published_date", "announce_date", "categories", "is_survey")
    out = U.merge_papers(old, U.built_rows(table(s, d, "raw_papers")))
    return out.drop("first_author_group").withColumn("categories", F.array_join("categories", ",")).withColumn("is_survey", F.coalesce("is_survey", F.lit(False)))


_PROV = "prov AS (SELECT paper_id, source, max(struct_pack(a := first_seen_at, b := source_id, c := source_url, d := raw)) AS m, min(first_seen_at) AS first_seen_at FROM paper_sources WHERE paper_id IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2)"


@query("WITH " + _PROV + " SELECT paper_id, source, m.b AS source_id, m.c AS source_url, md5(m.d) AS raw, first_seen_at FROM prov")
def provenance(s, d):
    return U.provenance(table(s, d, "paper_sources")).withColumn("raw", F.md5("raw"))


@query("SELECT paper_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(DISTINCT source) AS n FROM paper_sources WHERE paper_id IS NOT NULL AND source IS NOT NULL GROUP BY paper_id")
def sources_agg(s, d):
    return U.sources_of(table(s, d, "paper_sources")).withColumn("sources", F.array_join("sources", ","))


@query("SELECT source, count(*) AS rows, count(DISTINCT paper_id) AS papers, max(first_seen_at) AS latest FROM paper_sources GROUP BY source")
def source_report(s, d):
    return U.source_report(table(s, d, "paper_sources"))


@query("SELECT l_partkey AS cited_paper_id, count(DISTINCT l_orderkey) AS velocity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate > DATE '1998-06-30' - 42 GROUP BY 1")
def cocitation_velocity(s, d):
    edges = table(s, d, "lineitem").select(F.col("l_orderkey").alias("citing_paper_id"), F.col("l_partkey").alias("cited_paper_id"))
    seen = table(s, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderdate").alias("first_seen"))
    return S.cocitation_velocity(edges, seen, F.lit("1998-06-30").cast("date"))


@query("WITH r AS (SELECT left_key AS citing, right_key AS ext FROM match_pairs WHERE left_key IS NOT NULL), ids AS (SELECT DISTINCT canonical_key AS ext, paper_id FROM papers) SELECT DISTINCT citing AS citing_paper_id, paper_id AS cited_paper_id FROM r JOIN ids USING (ext) WHERE citing <> paper_id")
def reference_edges(s, d):
    refs = table(s, d, "match_pairs").where("left_key IS NOT NULL").groupBy(F.col("left_key").alias("citing_paper_id")).agg(F.collect_set("right_key").alias("referenced"))
    return S.reference_edges(refs, papers(s, d).select(F.col("canonical_key").alias("external_id"), F.col("paper_id").alias("cited_paper_id")))


_SNAP = "snap AS (SELECT l_partkey AS paper_id, last_day(l_shipdate::DATE) AS snapshot_date, sum(count(*)) OVER (PARTITION BY l_partkey ORDER BY last_day(l_shipdate::DATE))::BIGINT AS citation_count FROM lineitem GROUP BY 1, 2)"


def _snapshots(s, d):
    from pyspark.sql import Window as W

    rows = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("paper_id"), F.last_day("l_shipdate").alias("snapshot_date")).agg(F.count("*").alias("n"))
    return rows.select("paper_id", "snapshot_date", F.sum("n").over(W.partitionBy("paper_id").orderBy("snapshot_date")).alias("citation_count"))


@query("WITH " + _SNAP + ", latest AS (SELECT paper_id, max(snapshot_date) AS d, arg_max(citation_count, snapshot_date) AS citation_count FROM snap GROUP BY 1), prior AS (SELECT s.paper_id, arg_min(s.citation_count, (abs(date_diff('day', s.snapshot_date, l.d - 30)), s.snapshot_date)) AS c FROM snap s JOIN latest l USING (paper_id) WHERE s.snapshot_date <= l.d - 14 GROUP BY 1) SELECT paper_id, citation_count, citation_count - c AS delta_30d, CASE WHEN c IS NULL THEN 'ndata' WHEN citation_count - c >= 5 THEN 'hot' WHEN citation_count - c >= 1 THEN 'warming' ELSE 'flat' END AS tier FROM latest LEFT JOIN prior USING (paper_id)")
def citation_tiers(s, d):
    return S.citation_tiers(_snapshots(s, d))


@query("WITH " + _SNAP + ", latest AS (SELECT paper_id, max(snapshot_date) AS d FROM snap GROUP BY 1) SELECT p_partkey AS paper_id FROM part WHERE p_partkey NOT IN (SELECT paper_id FROM latest WHERE d > DATE '2001-08-31') ORDER BY p_partkey LIMIT 400")
def missing_snapshot(s, d):
    latest = _snapshots(s, d).groupBy("paper_id").agg(F.max("snapshot_date").alias("d")).where(F.col("d") > F.lit("2001-08-31").cast("date"))
    seen = table(s, d, "part").select(F.col("p_partkey").alias("paper_id"), F.lit("1998-01-01").cast("timestamp").alias("first_seen_at"))
    return S.missing_snapshots(seen, latest, F.lit("2001-12-01").cast("date"))


_UPVOTES = "up AS (SELECT user_id AS paper_id, ts::DATE AS snapshot_date, count(*) AS upvotes FROM events GROUP BY 1, 2)"


@query("WITH " + _UPVOTES + " SELECT paper_id, arg_max(upvotes, snapshot_date) AS upvotes FROM up GROUP BY 1")
def latest_upvotes(s, d):
    up = table(s, d, "events").groupBy(F.col("user_id").alias("paper_id"), F.to_date("ts").alias("snapshot_date")).agg(F.count("*").alias("upvotes"))
    return S.latest_value(up, "paper_id", "snapshot_date", "upvotes")


_COS = "list_cosine_similarity(i.embedding::DOUBLE[], a.embedding::DOUBLE[])"


@query(f"SELECT i.vec_id AS paper_id, a.vec_id AS anchor_id, round({_COS}, 6) AS sim FROM embeddings i, embeddings a WHERE a.vec_id < 5")
def anchor_similarity(s, d):
    e = table(s, d, "embeddings")
    items = e.select(F.col("vec_id").alias("paper_id"), F.col("embedding").alias("v"))
    anchors = e.where("vec_id < 5").select(F.col("vec_id").alias("anchor_id"), F.col("embedding").alias("v"))
    return S.anchor_similarity(items, anchors).withColumn("sim", F.round("sim", 6))


@query(f"WITH x AS (SELECT i.vec_id AS paper_id, a.vec_id AS anchor_id, {_COS} AS sim FROM embeddings i, embeddings a WHERE a.vec_id < 5) SELECT paper_id, round(coalesce(max(sim) FILTER (WHERE sim > 0), 0.0), 6) AS sim, arg_max(anchor_id, sim) FILTER (WHERE sim > 0) AS anchor_id FROM x GROUP BY 1")
def best_anchor(s, d):
    e = table(s, d, "embeddings")
    items = e.select(F.col("vec_id").alias("paper_id"), F.col("embedding").alias("v"))
    return S.best_anchor(items, e.where("vec_id < 5").select(F.col("vec_id").alias("anchor_id"), F.col("embedding").alias("v"))).withColumn("sim", F.round("sim", 6))


@query("WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) SELECT label, pos::INTEGER - 1 AS pos, round(avg(x), 6) AS x FROM x GROUP BY 1, 2")
def liked_centroid(s, d):
    means = V.mean_vector(table(s, d, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


_PV = f"pv AS (SELECT paper_id, arg_max(embedding, created_at) AS v FROM paper_vectors WHERE model_version = '{MODEL}' AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 GROUP BY 1)"


def _paper_vectors(s, d):
    rows = table(s, d, "paper_vectors").where((F.col("model_version") == MODEL) & (F.size("embedding") == DIM) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    return rows.groupBy("paper_id").agg(F.max_by("embedding", "created_at").alias("v"))


@query("WITH p AS (SELECT DISTINCT paper_id FROM papers), " + _PV + " SELECT paper_id FROM p WHERE paper_id NOT IN (SELECT paper_id FROM pv)")
def missing_embedding(s, d):
    return S.missing_embeddings(table(s, d, "papers"), _paper_vectors(s, d))


# Scoring over the papers of the last weeks, with the vectors of the first five papers as anchors.
DOMAIN = ["transformer", "ultrasound", "scans", "noise", "self-supervised"]
_ANCHORS = _PV + f", anchors AS (SELECT paper_id AS anchor_id, v AS a FROM pv ORDER BY paper_id LIMIT {ANCHORS})"
_SCORE = (
    "WITH "
    + MOMENTUM
    + ", "
    + _ANCHORS
    + f", universe AS MATERIALIZED (SELECT *, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS low FROM p WHERE NOT coalesce(muted, false) AND (first_seen_at::DATE > DATE '{AS_OF}' - 10 OR announce_date > DATE '{AS_OF}' - 21) ORDER BY first_seen_at DESC NULLS LAST, paper_id LIMIT {S.UNIVERSE_CAP}), "
    "matched AS (" + _match("universe", "paper_id", "low") + "), lex AS (SELECT paper_id, sum(weight * greatest(0.0, coalesce(momentum, 0.0))) AS lexical, min(term) AS tag, array_to_string(list_sort(list(term)), '; ') AS matched FROM matched LEFT JOIN momentum USING (term) GROUP BY 1), "
    "con AS (SELECT paper_id, count(*) AS n FROM (" + _match("universe", "paper_id", "lower(array_to_string(concepts, ' '))") + ") GROUP BY 1), "
    "sims AS (SELECT paper_id, coalesce(max(x) FILTER (WHERE x > 0), 0.0) AS sim FROM (SELECT pv.paper_id, list_cosine_similarity(pv.v::DOUBLE[], a::DOUBLE[]) AS x FROM pv, anchors) GROUP BY 1), "
    f"co AS (SELECT right_key AS paper_id, count(DISTINCT left_key) AS n FROM match_pairs JOIN p ON p.paper_id = left_key WHERE p.first_seen_at::DATE > DATE '{AS_OF}' - 364 GROUP BY 1), "
    "up AS (SELECT paper_id, max(TRY_CAST(CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.upvotes') END AS DOUBLE)) AS n FROM paper_sources GROUP BY 1), "
    "signals AS MATERIALIZED (SELECT u.paper_id, u.first_seen_at, " + " OR ".join(f"regexp_matches(u.low, '{_border(t)}')" for t in DOMAIN) + " AS in_domain, lex.tag, coalesce(lex.matched, '') AS matched, coalesce(lexical, 0.0) AS lexical, round_even(sim, 4) AS embedding_sim, coalesce(con.n, 0)::DOUBLE AS concept_overlap, coalesce(co.n, 0)::DOUBLE AS cocitation_velocity, coalesce(up.n, 0.0) AS hf_upvotes FROM universe u LEFT JOIN lex USING (paper_id) LEFT JOIN con USING (paper_id) LEFT JOIN sims USING (paper_id) LEFT JOIN co USING (paper_id) LEFT JOIN up USING (paper_id)), "
    "gated AS (SELECT * FROM signals WHERE " + " OR ".join(f"coalesce({k} >= {v}, false)" for k, v in S.THRESHOLDS.items()) + "), "
    "n AS (SELECT *, " + ", ".join(f"CASE WHEN max(coalesce({c}, 0.0)) OVER () - min(coalesce({c}, 0.0)) OVER () <= 1e-9 THEN 0.0 ELSE (coalesce({c}, 0.0) - min(coalesce({c}, 0.0)) OVER ()) / (max(coalesce({c}, 0.0)) OVER () - min(coalesce({c}, 0.0)) OVER ()) END AS norm_{c}" for c in S.RANK_WEIGHTS) + " FROM gated), "
    "comp AS (SELECT *, round_even(" + " + ".join(f"{w} * norm_{c}" for c, w in S.RANK_WEIGHTS.items()) + ", 5) AS composite FROM n), "
    f"cards AS (SELECT *, row_number() OVER (ORDER BY composite DESC, first_seen_at DESC NULLS LAST, paper_id) AS rank FROM comp WHERE in_domain QUALIFY rank <= {S.HARD_CAP}), "
    "t AS (SELECT *, coalesce(embedding_sim, 0.0) AS sim, row_number() OVER (PARTITION BY coalesce(tag, '—') ORDER BY coalesce(embedding_sim, 0.0) DESC, first_seen_at DESC NULLS LAST, paper_id) AS rn FROM comp WHERE NOT in_domain), "
    f"crossed AS (SELECT * EXCLUDE (composite), NULL::DOUBLE AS composite, row_number() OVER (ORDER BY sim DESC, first_seen_at DESC NULLS LAST, paper_id) AS rank FROM t WHERE rn <= {S.PER_TAG} QUALIFY rank <= {S.CROSS_CAP})"
)


def _universe(s, d):
    """The candidates as a written table, so that what joins them is cut to them first."""
    return Scratch(s, "universe").save(S.universe(papers(s, d).select("paper_id", "title", "abstract", "concepts", "muted", "first_seen_at", "announce_date"), as_of()), "candidates")


def _anchor_rows(s, d):
    return _paper_vectors(s, d).orderBy("paper_id").limit(ANCHORS).select(F.col("paper_id").alias("anchor_id"), "v")


def _signals(s, d):
    candidates = _universe(s, d)
    ids = F.broadcast(candidates.select("paper_id"))
    weights = s.createDataFrame(list(WEIGHTS.items()), "term string, weight double")
    edges = table(s, d, "match_pairs").select(F.col("left_key").alias("citing_paper_id"), F.col("right_key").alias("cited_paper_id")).join(ids.withColumnRenamed("paper_id", "cited_paper_id"), "cited_paper_id", "left_semi")
    seen = papers(s, d).select("paper_id", F.col("first_seen_at").cast("date").alias("first_seen"))
    velocity = S.cocitation_velocity(edges, seen, as_of(), 52).withColumnRenamed("cited_paper_id", "paper_id")
    up = table(s, d, "paper_sources").join(ids, "paper_id", "left_semi").groupBy("paper_id").agg(F.max(F.get_json_object("raw", "$.upvotes").try_cast("double")).alias("upvotes"))
    return S.score_signals(candidates, TERMS, DOMAIN, weights, T.momentum(_counts(s, d), TERMS, CURRENT), _paper_vectors(s, d), _anchor_rows(s, d), velocity, up)


_NAMES = list(S.RANK_WEIGHTS)


def _broad(s, d):
    return S.score_broad(Scratch(s, "signals").save(_signals(s, d), "signals"))


@query(_SCORE + " SELECT paper_id, in_domain, matched, " + ", ".join(f"round({n}, 6) AS {n}" for n in _NAMES) + " FROM signals")
def score_signals(s, d):
    return _signals(s, d).select("paper_id", "in_domain", F.array_join("matched", "; ").alias("matched"), *[F.round(n, 6).alias(n) for n in _NAMES])


@query(_SCORE + " SELECT paper_id FROM gated")
def recall_gate(s, d):
    return S.recall_gate(_signals(s, d)).select("paper_id")


@query(_SCORE + " SELECT paper_id, composite, rank FROM cards")
def composite_rank(s, d):
    return _broad(s, d)["cards"].select("paper_id", "composite", F.col("rank").cast("long").alias("rank"))


@query(_SCORE + " SELECT paper_id, tag, sim, rank FROM crossed")
def cross_domain_capped(s, d):
    return _broad(s, d)["cross_domain"].select("paper_id", "tag", "sim", F.col("rank").cast("long").alias("rank"))


@query(_SCORE + f" SELECT least((SELECT count(*) FROM comp WHERE in_domain), {S.HARD_CAP}) AS surfaced, (SELECT count(*) FROM signals) AS universe, CASE WHEN (SELECT count(*) FROM comp WHERE in_domain) > {S.HARD_CAP} THEN {S.HARD_CAP} END AS truncated_at")
def score_summary(s, d):
    return _broad(s, d)["summary"]


_LEDGER = ", l AS (UNPIVOT (SELECT paper_id, kind, " + ", ".join(f"{n}::DOUBLE AS {n}" for n in _NAMES) + ", rank::DOUBLE AS rank FROM (SELECT *, 'composite_rank' AS kind FROM cards UNION ALL BY NAME SELECT *, 'cross_domain_rank' AS kind FROM crossed)) ON COLUMNS(* EXCLUDE (paper_id, kind)) INTO NAME name VALUE value)"


@query(_SCORE + _LEDGER + " SELECT paper_id, DATE '" + AS_OF + "' AS run_date, CASE WHEN name = 'rank' THEN kind ELSE name END AS name, round(value, 4) AS value FROM l")
def signals_ledger(s, d):
    both = _broad(s, d)
    rows = S.signals_ledger(both["cards"], as_of(), _NAMES, "composite_rank").unionByName(S.signals_ledger(both["cross_domain"], as_of(), _NAMES, "cross_domain_rank"))
    return rows.withColumn("value", F.round("value", 4))


_WHY = (
    "concat_ws('; ', CASE WHEN matched <> '' THEN 'matches ' || array_to_string(list_transform(string_split(matched, '; ')[:4], lambda x: chr(39) || x || chr(39)), ', ') END, "
    "CASE WHEN cocitation_velocity > 0 THEN 'cited by ' || cocitation_velocity::INTEGER || ' recent paper(s)' END, CASE WHEN hf_upvotes > 0 THEN hf_upvotes::INTEGER || ' HF upvotes' END)"
)


@query(_SCORE + f", src AS (SELECT paper_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM paper_sources WHERE source IS NOT NULL GROUP BY 1) SELECT cards.paper_id, rank, p.title, coalesce(sources, '') AS sources, 'ndata' AS tier, '—' AS badge, CASE WHEN {_WHY} = '' THEN 'passed recall gate' ELSE {_WHY} END AS why FROM cards JOIN p USING (paper_id) LEFT JOIN src USING (paper_id)")
def score_cards(s, d):
    cards = _broad(s, d)["cards"].withColumn("anchor_id", F.lit(None).cast("string"))
    none = s.createDataFrame([], "paper_id string, tier string, delta_30d bigint")
    anchors = s.createDataFrame([], "anchor_id string, anchor_kind string, anchor_text string")
    out = S.dressed(cards, table(s, d, "papers"), table(s, d, "paper_sources").where("source IS NOT NULL"), none, anchors)
    return out.select("paper_id", F.col("rank").cast("long").alias("rank"), "title", F.array_join("sources", ",").alias("sources"), "tier", "badge", "why")


@query(_SCORE + ", g AS (SELECT coalesce(tag, 'other') AS tag, min(rank) AS f, count(*) AS n FROM cards GROUP BY 1) SELECT row_number() OVER (ORDER BY tag = 'other', f) AS place, tag, n FROM g")
def cards_by_tag(s, d):
    return S.by_tag(_broad(s, d)["cards"]).withColumn("place", F.col("place").cast("long"))


@query("WITH p AS (SELECT DISTINCT * FROM papers), " + _terms_sql(PHRASES) + ", " + _ANCHORS + f", r AS (SELECT *, coalesce(announce_date, first_seen_at::DATE) AS day, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS low FROM p WHERE NOT coalesce(muted, false) AND (first_seen_at::DATE > DATE '{AS_OF}' - 60 OR announce_date > DATE '{AS_OF}' - 60) ORDER BY day DESC, paper_id LIMIT 1500), m AS (SELECT paper_id, announce_date, array_to_string(list_sort(list(DISTINCT term)), '; ') AS matched FROM (" + _match("r", "paper_id, announce_date", "low", PHRASES) + f") GROUP BY 1, 2), sims AS (SELECT paper_id, max(x) AS sim FROM (SELECT pv.paper_id, list_cosine_similarity(pv.v::DOUBLE[], a::DOUBLE[]) AS x FROM pv, anchors) GROUP BY 1) SELECT paper_id, announce_date, round_even(coalesce(sim, 0.0), 4) AS similarity, matched, paper_id NOT IN (SELECT paper_id FROM documents WHERE paper_id IS NOT NULL AND section = 'digest_note') AS new_since_last_digest, row_number() OVER (ORDER BY announce_date DESC NULLS LAST, coalesce(sim, 0.0) DESC, paper_id) AS rank FROM m LEFT JOIN sims USING (paper_id) QUALIFY rank <= 40")
def niche_feed(s, d):
    shown = table(s, d, "documents").where("paper_id IS NOT NULL AND section = 'digest_note'").select("paper_id")
    out = S.niche_feed(papers(s, d), PHRASES, S.greatest_similarity(_paper_vectors(s, d), _anchor_rows(s, d)), as_of(), days=60, last_digest=shown)
    return out.withColumn("rank", F.col("rank").cast("long"))


# Vocabulary: the weekly table's terms; seed or learned by their length, weight by their total.
_WEEKS = "wk AS (SELECT lower(trim(regexp_replace(term, '\\s+', ' ', 'g'))) AS term, count, TRY_CAST(regexp_extract(upper(trim(iso_week)), '^(\\d{4})[-/ ]?W(\\d{1,2})$', 1) AS INTEGER) AS y, TRY_CAST(regexp_extract(upper(trim(iso_week)), '^(\\d{4})[-/ ]?W(\\d{1,2})$', 2) AS INTEGER) AS k FROM term_counts WHERE term IS NOT NULL)"


@query("WITH " + _WEEKS + ", v0 AS (SELECT term, max(CASE WHEN count > 0 AND k BETWEEN 1 AND 53 THEN (date_trunc('week', make_date(y, 1, 4)) + INTERVAL 7 DAY * (k - 1))::DATE END) AS seen, sum(count) AS total FROM wk GROUP BY 1), v AS (SELECT term, length(term) % 3 = 0 AS is_seed, (least(coalesce(total, 0), 400)::DOUBLE / 1000)::FLOAT * 0.97::FLOAT AS weight, seen FROM v0) SELECT term, is_seed, round(weight::DOUBLE, 5) AS weight FROM v WHERE is_seed OR weight >= 0.15 OR (seen IS NOT NULL AND date_diff('day', seen, DATE '2023-06-26') / 7 < 4)")
def vocab_decay_prune(s, d):
    rows = table(s, d, "term_counts").where("term IS NOT NULL").select(F.lower(F.trim(F.regexp_replace("term", r"\s+", " "))).alias("term"), R.week_monday(F.col("iso_week")).alias("monday"), "count")
    total = rows.groupBy("term").agg(F.max(F.when(F.col("count") > 0, F.col("monday"))).alias("last_seen_monday"), F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    vocab = total.select("term", (F.length("term") % 3 == 0).alias("is_seed"), (F.least("total", F.lit(400)).cast("double") / 1000).cast("float").alias("weight"), "last_seen_monday")
    return C.prune(C.decay(vocab), F.lit("2023-06-26").cast("date")).select("term", "is_seed", F.round(F.col("weight").cast("double"), 5).alias("weight"))


# Liked papers: those that a review note is about.
_LIKED = "liked AS (SELECT p.* FROM p WHERE paper_id IN (SELECT paper_id FROM documents WHERE section = 'review_note'))"
_LIKED_GRAMS = "WITH p AS (SELECT DISTINCT * FROM papers), " + _LIKED + ", " + _grams_sql("liked", "coalesce(title, '') || ' ' || coalesce(abstract, '')", "paper_id") + f", c AS (SELECT g AS term, count(*) AS n FROM (SELECT unnest(list_distinct(list_concat(bigrams, acronyms))) AS g FROM gb) WHERE NOT list_contains({_list(TERMS)}, g) GROUP BY 1)"


def _liked(s, d):
    seen = table(s, d, "documents").where("section = 'review_note' AND paper_id IS NOT NULL").select("paper_id")
    return papers(s, d).join(seen, "paper_id", "left_semi")


def _terms_df(s):
    return s.createDataFrame([(t,) for t in TERMS], "term string")


@query(_LIKED_GRAMS + " SELECT term, n, CASE WHEN n >= 2 THEN 1.0 ELSE 0.4 END::DOUBLE AS weight FROM c ORDER BY n DESC, term LIMIT 6")
def vocab_growth(s, d):
    notes = table(s, d, "documents").where("section = 'review_note' AND paper_id IS NOT NULL")
    feedback = notes.select("paper_id", F.lit("liked").alias("verdict"), F.lit(False).alias("processed_for_vocab"))
    return C.growth(feedback, papers(s, d), _terms_df(s), learned=12)[0]


@query(_LIKED_GRAMS + " SELECT term, n FROM c WHERE n >= 2 ORDER BY n DESC, term LIMIT 10")
def suggestions(s, d):
    return C.suggestions(_liked(s, d), _terms_df(s), _terms_df(s).limit(0))


@query("SELECT DISTINCT lower(trim(regexp_replace(term, '\\s+', ' ', 'g'))) AS term FROM term_counts UNION SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in TERMS) + ") AS v(term)")
def tracked_terms(s, d):
    return T.tracked_terms(table(s, d, "term_counts").select(F.lower(F.trim(F.regexp_replace("term", r"\s+", " "))).alias("term")), _terms_df(s))


SEARCH = "registration of knee scans under weak labels"


@query("WITH p AS (SELECT DISTINCT * FROM papers), m AS (SELECT paper_id, coalesce(announce_date, first_seen_at::DATE) AS day, title || ' ' || coalesce(abstract, '') AS t, " + " AND ".join(f"regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '{_border(w)}')" for w in ("registration", "knee", "scans", "under", "weak")) + f" AS matched_locally FROM p WHERE NOT coalesce(muted, false)) SELECT paper_id, day, matched_locally FROM m WHERE matched_locally OR t ILIKE '%{SEARCH}%' ORDER BY day DESC NULLS LAST, paper_id LIMIT 150")
def saved_search(s, d):
    return C.saved_search(papers(s, d), SEARCH, ["registration", "knee", "scans", "under", "weak"])


@query(f"WITH w AS (SELECT raw_id, list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3 AND NOT list_contains({_list(L.SEARCH_STOPWORDS)}, w)) AS ws FROM raw_papers WHERE title IS NOT NULL) SELECT raw_id, array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: list_position(ws, ws[i]) = i), lambda i: ws[i])[:5], ' ') AS words FROM w")
def significant_words(s, d):
    return table(s, d, "raw_papers").where("title IS NOT NULL").select("raw_id", F.array_join(X.significant_words(F.col("title")), " ").alias("words"))


# Digest cards: events of a day in order; outcomes by kind of event.
_CARDS = "cards AS (SELECT ts::DATE AS run_date, user_id AS paper_id, CASE WHEN user_id % 2 = 0 THEN 'broad' ELSE 'niche' END AS section, row_number() OVER (PARTITION BY ts::DATE, user_id % 2 = 0 ORDER BY event_id) AS rank, CASE event_type WHEN 'purchase' THEN 'liked' WHEN 'error' THEN 'disliked' WHEN 'click' THEN 'saved' WHEN 'signup' THEN 'ignored' END AS outcome, event_id FROM events)"


def _cards(s, d):
    from pyspark.sql import Window as W

    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "liked").when(kind == "error", "disliked").when(kind == "click", "saved").when(kind == "signup", "ignored")
    even = F.col("user_id") % 2 == 0
    rank = F.row_number().over(W.partitionBy(F.to_date("ts"), even).orderBy("event_id"))
    return table(s, d, "events").select(F.to_date("ts").alias("run_date"), F.col("user_id").alias("paper_id"), F.when(even, "broad").otherwise("niche").alias("section"), rank.alias("rank"), outcome.alias("outcome"), "event_id")


@query("WITH " + _CARDS + ", b AS (SELECT strftime(run_date, '%G-W%V') AS week, CASE WHEN outcome = 'liked' THEN 'liked' WHEN outcome IN ('disliked', 'muted') THEN 'disliked' WHEN outcome = 'ignored' OR DATE '2024-01-31' - run_date >= 5 THEN 'ignored' ELSE 'pending' END AS b FROM cards WHERE section = 'broad' AND rank <= 10 AND run_date > DATE '2024-01-31' - 56), w AS (SELECT week, count(*) FILTER (WHERE b = 'liked') AS liked, count(*) FILTER (WHERE b = 'disliked') AS disliked, count(*) FILTER (WHERE b = 'ignored') AS ignored, count(*) FILTER (WHERE b = 'pending') AS pending, count(*) AS n FROM b GROUP BY 1) SELECT *, round(liked::DOUBLE / nullif(liked + disliked + ignored, 0), 3) AS precision FROM w")
def precision_at_k(s, d):
    return C.precision_at_k(_cards(s, d), F.lit("2024-01-31").cast("date"))


@query("WITH " + _CARDS + ", w AS (SELECT run_date, count(*) FILTER (WHERE outcome = 'liked') AS liked, count(*) FILTER (WHERE outcome IN ('disliked', 'muted')) AS disliked, count(*) FILTER (WHERE outcome = 'ignored') AS ignored, count(*) AS shown FROM cards GROUP BY 1) SELECT *, liked::DOUBLE / nullif(liked + disliked + ignored, 0) AS precision FROM w")
def working_series(s, d):
    return C.working_series(_cards(s, d))


# Labels: surveys "blew up"; cards: the documents about a paper, shown on the day they were added.
@query("WITH p AS (SELECT DISTINCT paper_id, first_seen_at FROM papers WHERE is_survey), c AS (SELECT paper_id, min(added_at::DATE) AS surfaced FROM documents WHERE paper_id IS NOT NULL GROUP BY 1) SELECT paper_id, surfaced, date_diff('day', first_seen_at::DATE, surfaced) AS lead_days, surfaced IS NULL AS missed FROM p LEFT JOIN c USING (paper_id)")
def lead_time_audit(s, d):
    labels = table(s, d, "papers").select("paper_id", F.when(F.col("is_survey"), "blew_up").otherwise("quiet").alias("label"))
    cards = table(s, d, "documents").where("paper_id IS NOT NULL").select("paper_id", F.to_date("added_at").alias("run_date"))
    return C.lead_time(labels, papers(s, d), cards).withColumn("lead_days", F.col("lead_days").cast("long"))


@query(r"SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[\s\x0B\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')), '') AS text FROM documents")
def strip_tags(s, d):
    return table(s, d, "documents").select("doc_id", X.strip_tags(F.col("text")).alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[\s\x0B\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS text FROM documents")
def normalize_ws(s, d):
    return table(s, d, "documents").select("doc_id", X.normalize_ws(F.col("text")).alias("text"))


@query(r"WITH p AS (SELECT DISTINCT * FROM papers) SELECT paper_id, coalesce(repo_url, nullif(regexp_extract(abstract, '(?i)(https?://github\.com/[\w.\-]+/[\w.\-]+)', 1), '')) AS repo_url FROM p")
def repository_tags(s, d):
    return papers(s, d).select("paper_id", F.coalesce("repo_url", X.github_url(F.col("abstract"))).alias("repo_url"))


# Clusters of two periods: the papers of a category, as papers has them and as the incoming records do.
@query("WITH a AS (SELECT DISTINCT unnest(categories) AS cluster, first_author_group AS member FROM papers WHERE first_author_group IS NOT NULL), b AS (SELECT DISTINCT unnest(categories) AS previous, first_author_group AS member FROM raw_papers WHERE first_author_group IS NOT NULL), na AS (SELECT cluster, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT previous, count(*) AS nb FROM b GROUP BY 1), j AS (SELECT cluster, previous, count(*) AS n FROM a JOIN b USING (member) GROUP BY 1, 2), x AS (SELECT cluster, previous, n::DOUBLE / (na + nb - n) AS jaccard FROM j JOIN na USING (cluster) JOIN nb USING (previous)), y AS (SELECT * FROM x WHERE jaccard >= 0.2 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY jaccard DESC, previous) = 1) SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY previous ORDER BY jaccard DESC, cluster) = 1")
def cluster_match_jaccard(s, d):
    members = lambda name: table(s, d, name).where("first_author_group IS NOT NULL").select(F.explode("categories").alias("cluster"), F.col("first_author_group").alias("member"))
    return C.jaccard_matches(members("papers"), members("raw_papers"), 0.2)


@query("WITH " + _CARDS + ", g AS (SELECT run_date, section, to_json(list(CASE WHEN outcome IS NULL THEN json_object('rank', rank, 'paper_id', paper_id) ELSE json_object('rank', rank, 'paper_id', paper_id, 'outcome', outcome) END ORDER BY rank)) AS cards FROM cards GROUP BY 1, 2) SELECT run_date, section, cards::VARCHAR AS cards FROM g")
def digest_json(s, d):
    return C.digest(_cards(s, d))


_FOLDED = (
    "lines AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\n\\r]*(?:\\r\\n|\\n|\\r)|[^\\n\\r]+') AS ls FROM documents), "
    "pieces AS (SELECT doc_id, flatten(list_transform(ls, lambda l: regexp_extract_all(l, '(?s).{1,200}'))) AS ps FROM lines), "
    "folded AS (SELECT doc_id, CASE WHEN len(ps) = 0 THEN [''] ELSE list_reduce(list_transform(ps, lambda p: [p]), lambda a, p: CASE WHEN length(a[-1]) + length(p[1]) > 200 THEN list_append(a, p[1]) ELSE list_append(a[:-2], a[-1] || p[1]) END) END AS chunks FROM pieces)"
)


@query("WITH " + _FOLDED + " SELECT doc_id, len(chunks) AS n, array_to_string(chunks, '|') AS chunks FROM folded")
def delivery_chunks(s, d):
    """Messages of at most 200 characters, so that most texts need several."""
    chunks = C.chunks(F.col("text"), 200)
    return table(s, d, "documents").select("doc_id", F.size(chunks).cast("long").alias("n"), F.array_join(chunks, "|").alias("chunks"))


@query("SELECT date_trunc('week', coalesce(announce_date, published_date))::DATE AS monday, count(*) AS count FROM raw_papers WHERE coalesce(announce_date, published_date) IS NOT NULL GROUP BY 1")
def weekly_windows(s, d):
    rows = table(s, d, "raw_papers").select(F.coalesce("announce_date", "published_date").cast("timestamp").alias("at")).where("at IS NOT NULL")
    return weekly(rows, "at")


# Clusters: terms of the catalogue's titles, its venues as clusters; categories as clusters of vectors and of papers.
_TFIDF = (
    f"tw AS (SELECT record_id AS id, list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 2 AND NOT list_contains({_list(L.STOPWORDS)}, x)) AS w FROM venue_records), "
    "tg AS (SELECT id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tw), tc AS (SELECT id, term, count(*) AS tf FROM tg GROUP BY 1, 2), "
    "tk AS (SELECT term, sum(tf) AS a, count(*) AS df FROM tc GROUP BY 1 ORDER BY a DESC, term LIMIT 500), ti AS (SELECT term, ln((1 + (SELECT count(*) FROM tw)) / (1 + df)::DOUBLE) + 1 AS idf FROM tk), "
    "tx AS (SELECT id, term, tf * idf AS x FROM tc JOIN ti USING (term)), weights AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM tx)"
)


def _weights(s, d):
    return G.term_weights(table(s, d, "venue_records").select(F.col("record_id").alias("id"), F.col("title").alias("text")), 500)


@query("WITH " + _TFIDF + " SELECT id, term, round(weight, 6) AS weight FROM weights")
def term_weights(s, d):
    return _weights(s, d).withColumn("weight", F.round("weight", 6))


@query("WITH " + _TFIDF + ", ms AS (SELECT record_id AS id, venue AS label FROM venue_records WHERE venue IS NOT NULL), sz AS (SELECT label, count(*) AS n FROM ms GROUP BY 1), mw AS (SELECT label, term, sum(weight) / any_value(n) AS weight FROM ms JOIN weights USING (id) JOIN sz USING (label) GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(weight, 9) DESC, term) AS place FROM mw) SELECT label, term, place, round(weight, 6) AS weight FROM rk WHERE place <= 6")
def cluster_labels(s, d):
    members = table(s, d, "venue_records").where("venue IS NOT NULL").select(F.col("record_id").alias("paper_id"), F.col("venue").alias("label"))
    return G.label_terms(members, _weights(s, d)).withColumns({"weight": F.round("weight", 6), "place": F.col("place").cast("long")})


_MEMBERS = "members AS (SELECT DISTINCT paper_id, categories[1] AS label FROM papers WHERE len(categories) > 0)"


def _members(s, d):
    return papers(s, d).where(F.size("categories") > 0).select("paper_id", F.col("categories")[0].alias("label"))


@query("WITH " + _PV + ", " + _MEMBERS + ", mv AS (SELECT paper_id, label, v FROM members JOIN pv USING (paper_id)), el AS (SELECT label, generate_subscripts(v, 1) AS pos, unnest(v)::DOUBLE AS x FROM mv), mean AS (SELECT label, pos, avg(x) AS x FROM el GROUP BY 1, 2), cs AS (SELECT label, list(x ORDER BY pos) AS c FROM mean GROUP BY 1), ds AS (SELECT label, paper_id, list_distance(v::DOUBLE[], c) AS distance FROM mv JOIN cs USING (label)), rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), paper_id) AS place FROM ds) SELECT label, paper_id, place, round(distance, 5) AS distance FROM rk WHERE place <= 3")
def cluster_representatives(s, d):
    return G.representatives(_members(s, d), _paper_vectors(s, d)).withColumns({"distance": F.round("distance", 5), "place": F.col("place").cast("long")})


@query(
    "WITH " + _MEMBERS + ", prev AS (SELECT DISTINCT 'old:' || categories[1] AS old, paper_id FROM papers WHERE len(categories) > 0 AND abstract IS NOT NULL), a AS (SELECT label, count(*) AS n FROM members GROUP BY 1), b AS (SELECT old, count(*) AS m FROM prev GROUP BY 1), "
    "j AS (SELECT label, old, count(*)::DOUBLE AS k FROM members JOIN prev USING (paper_id) GROUP BY 1, 2), x AS (SELECT label, old, k / (n + m - k) AS q, m FROM j JOIN a USING (label) JOIN b USING (old)), y AS (SELECT * FROM x WHERE q >= 0.5 QUALIFY row_number() OVER (PARTITION BY label ORDER BY q DESC, old) = 1), z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY old ORDER BY q DESC, label) = 1), "
    "mk AS (SELECT label, '2023-06:' || substr(sha1(array_to_string(list_sort(list(paper_id))[:5], '|')), 1, 10) AS made FROM members GROUP BY 1) SELECT label, coalesce(old, made) AS cluster_key, n AS size, m AS prev_size FROM a JOIN mk USING (label) LEFT JOIN z USING (label)"
)
def cluster_keys(s, d):
    before = papers(s, d).where((F.size("categories") > 0) & F.col("abstract").isNotNull()).select(F.concat(F.lit("old:"), F.col("categories")[0]).alias("cluster_key"), "paper_id")
    return G.carried_keys(_members(s, d), before, "2023-06")


@query()
def density_clusters(s, d):
    """Density clusters of the vectors written in the last 30 days of the table."""
    rows = table(s, d, "paper_vectors")
    last = rows.agg(F.max("created_at").alias("t"))
    recent = rows.crossJoin(F.broadcast(last)).where(F.to_date("created_at") > F.date_sub(F.to_date("t"), 30)).drop("t")
    fresh = recent.where((F.col("model_version") == MODEL) & (F.size("embedding") == DIM) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    return G.density_clusters(fresh.groupBy("paper_id").agg(F.max_by("embedding", "created_at").alias("v")))


# Lists and records.
@query("WITH " + _CARDS + ", c AS (SELECT run_date, paper_id, section, min(rank) AS rank, min(outcome) AS outcome FROM cards GROUP BY ALL) SELECT run_date, paper_id, section, CASE WHEN rank % 2 = 0 THEN rank + 1000 ELSE rank END AS rank, outcome FROM c")
def cards_upsert(s, d):
    """A rerun that ranks every second card anew: ranks change, outcomes stay."""
    old = _cards(s, d).groupBy("run_date", "paper_id", "section").agg(F.min("rank").alias("rank"), F.min("outcome").alias("outcome"))
    new = old.where("rank % 2 = 0").select("run_date", "paper_id", "section", (F.col("rank") + 1000).alias("rank"), F.lit(None).cast("string").alias("outcome"))
    return D.put_cards(old, new).withColumn("rank", F.col("rank").cast("long"))


@query("WITH v AS (SELECT lower(trim(regexp_replace(term, '\\s+', ' ', 'g'))) AS term, sum(count) AS w FROM term_counts WHERE term IS NOT NULL GROUP BY 1), top AS (SELECT term FROM v ORDER BY w DESC NULLS LAST, term LIMIT 8) SELECT term AS query FROM top UNION SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in PHRASES) + ") AS t(query)")
def query_fan_out(s, d):
    rows = table(s, d, "term_counts").where("term IS NOT NULL").groupBy(F.lower(F.trim(F.regexp_replace("term", r"\s+", " "))).alias("term")).agg(F.sum("count").alias("weight")).withColumn("is_seed", F.lit(True))
    return D.fan_out(rows, s.createDataFrame([(x,) for x in PHRASES], "phrase string"))


@query(r"SELECT paper_id, doi FROM (SELECT DISTINCT paper_id, doi FROM papers WHERE abstract IS NULL AND doi IS NOT NULL) ORDER BY paper_id LIMIT 50")
def missing_abstracts(s, d):
    return S.missing_abstracts(papers(s, d))


@query("SELECT raw_id, 'abs:\"' || replace(regexp_replace(title, '^" + X.WHITE + "|" + X.WHITE + "$', '', 'g'), '\"', '') || '\"' AS exact FROM raw_papers WHERE title IS NOT NULL")
def search_query(s, d):
    built = X.archive_query(F.col("title"))
    return table(s, d, "raw_papers").where("title IS NOT NULL").select("raw_id", F.regexp_replace(built, r'^(abs:"[^"]*").*$', "$1").alias("exact"))


@query("SELECT event_id AS id, ts AS started_at, CASE WHEN value < 0.5 AND ts < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 25 MINUTE THEN 'error' WHEN value < 0.5 THEN 'running' ELSE 'ok' END AS status FROM events")
def reaped_runs(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("started_at"), F.when(F.col("value") < 0.5, "running").otherwise("ok").alias("status"), F.lit(None).cast("timestamp").alias("finished_at"))
    return D.reap(e, F.lit("2024-01-30").cast("timestamp")).select("id", "started_at", "status")


@query("SELECT event_id AS id FROM events ORDER BY event_id DESC LIMIT 25")
def last_runs(s, d):
    return D.last_rows(table(s, d, "events").select(F.col("event_id").alias("id")), 25)


# Problem 1.
_ROLL = (
    "rows AS (SELECT lower(trim(regexp_replace(term, '\\s+', ' ', 'g'))) AS term, upper(trim(iso_week)) AS w, count, computed_at FROM term_counts WHERE term IS NOT NULL), "
    "parsed AS (SELECT term, TRY_CAST(regexp_extract(w, '^(\\d{4})[-/ ]?W(\\d{1,2})$', 1) AS INTEGER) AS y, TRY_CAST(regexp_extract(w, '^(\\d{4})[-/ ]?W(\\d{1,2})$', 2) AS INTEGER) AS k, count, computed_at FROM rows), "
    "dated AS (SELECT term, (date_trunc('week', make_date(y, 1, 4)) + INTERVAL 7 DAY * (k - 1))::DATE AS monday, count, computed_at FROM parsed WHERE y IS NOT NULL AND k BETWEEN 1 AND 53), "
    "latest AS (SELECT term, date_diff('day', DATE '2020-06-29', monday) // 7 AS p, arg_max(coalesce(count, 0), (computed_at, coalesce(count, -1))) AS c FROM dated WHERE monday BETWEEN DATE '2020-06-29' AND DATE '2023-06-26' GROUP BY 1, 2), "
    "spine AS (SELECT term, p FROM (SELECT DISTINCT term FROM latest), range(0, 157) AS r(p)), full_weeks AS (SELECT term, p, coalesce(c, 0) AS c FROM spine LEFT JOIN latest USING (term, p)), "
    "totals AS (SELECT term, strftime(DATE '2020-06-29' + 7 * p::INTEGER, '%G-W%V') AS iso_week, c, sum(c) OVER (PARTITION BY term ORDER BY p ROWS 3 PRECEDING) AS t4, sum(c) OVER (PARTITION BY term ORDER BY p ROWS 12 PRECEDING) AS t13 FROM full_weeks)"
)


@query("WITH " + _ROLL + " SELECT term, iso_week FROM totals WHERE t4 >= 12 AND 3 * t4 > 2 * t13")
def p1_found(s, d):
    return R.rising_weeks(s, table(s, d, "term_counts"))


@query("WITH " + _ROLL + " SELECT term, iso_week, c::BIGINT AS count, t4::BIGINT AS total_4, t4::DOUBLE / 4 AS avg_4, t13::BIGINT AS total_13, t13::DOUBLE / 13 AS avg_13 FROM totals")
def p1_rolling(s, d):
    return R.rolling_totals(s, table(s, d, "term_counts"))
