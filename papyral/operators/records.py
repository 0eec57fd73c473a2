"""What a run leaves behind: digests, cards, logs, configuration, markers, and the lists that are read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyral.operators.upsert import upsert

SECTIONS = ("broad_ranked", "cross_domain", "niche_papers", "rising_terms", "bursts", "clusters_summary")


def digest_row(run_date: Column, mode: str, sections: dict[str, DataFrame], scanned: int) -> DataFrame:
    """One row: run_date, mode, a JSON array for each of SECTIONS (rows in order of ``rank`` or as their columns sort), papers_scanned.

    A section that is not given, or is empty, is ``[]``.  Sections are capped lists.
    """
    spark = next(iter(sections.values())).sparkSession
    row = spark.range(1).select(run_date.alias("run_date"), F.lit(mode).alias("mode"), F.lit(scanned).cast("bigint").alias("papers_scanned"))
    for name in SECTIONS:
        df = sections.get(name)
        if df is None:
            row = row.withColumn(name, F.lit("[]"))
            continue
        first = [c for c in ("rank", "place") if c in df.columns]
        columns = [*first, *[c for c in df.columns if c not in first]]
        row = row.crossJoin(df.agg(F.coalesce(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))), F.lit("[]")).alias(name)))
    return row.select("run_date", "mode", *SECTIONS, "papers_scanned")


def replace_by(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the rows of the keys that ``new`` brings, and ``new``: a rerun of a day replaces the day."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def card_rows(run_date: Column, **sections: DataFrame) -> DataFrame:
    """(run_date, paper_id, section, rank, outcome) of ranked sections."""
    out = None
    for name, df in sections.items():
        rows = df.select(run_date.alias("run_date"), "paper_id", F.lit(name).alias("section"), F.col("rank").cast("int").alias("rank"), F.lit(None).cast("string").alias("outcome"))
        out = rows if out is None else out.unionByName(rows)
    return out


def put_cards(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cards after a run: ranks are overwritten, outcomes that are known stay."""
    return upsert(old, new, ["run_date", "paper_id", "section"], {"rank": "new", "outcome": "first"})


def signed(c: Column) -> Column:
    """A number with its sign, without needless zeros."""
    plain = F.regexp_replace(F.format_string("%.4f", c.cast("double")), r"\.?0+$", "")
    return F.when(c >= 0, F.concat(F.lit("+"), plain)).otherwise(plain)


def delivery_lines(df: DataFrame, part: int, head: str | None, order: list, n: int, line: Column) -> DataFrame:
    """(part, place, line) of a section of at most ``n`` rows: its heading, a line a row, an empty line; nothing if it is empty."""
    from pyspark.sql import Window as W

    top = df.orderBy(*order).limit(n).withColumn("place", F.row_number().over(W.orderBy(*order))).select(F.lit(part).alias("part"), "place", line.alias("line"))
    if head is None:
        return top
    some = top.limit(1)
    return top.unionByName(some.select("part", F.lit(0).alias("place"), F.lit(head).alias("line"))).unionByName(some.select("part", F.lit(n + 1).alias("place"), F.lit("").alias("line")))


def delivery_text(run_date: str, mode: str, scanned: int, broad: DataFrame, niche: DataFrame, cross: DataFrame, rising: DataFrame, bursts: DataFrame, discovery: DataFrame) -> DataFrame:
    """(text): the digest as plain text, one row.  Sections in order: new names, new papers, rising terms, bursts, own field, niche.

    broad and cross: rank, title, why, link, badge; niche: rank, title, link, new_since_last_digest; rising: term, momentum,
    current; bursts: term, distinct_groups; discovery: term, tier, delta, current_count.
    """
    spark = broad.sparkSession
    count = lambda df, name: df.agg(F.count("*").cast("string").alias(name))
    head = count(cross, "x").crossJoin(count(broad, "b")).crossJoin(count(niche, "n"))
    head = head.select(F.lit(0).alias("part"), F.lit(1).alias("place"), F.concat(F.lit(f"Digest of {run_date} ({mode})\nscanned {scanned} papers | new-field "), "x", F.lit(" | in-field "), "b", F.lit(" | niche "), "n", F.lit("\n")).alias("line"))
    link = F.coalesce("link", F.lit(""))
    paper = lambda title: F.concat(F.lit("  "), F.col("rank").cast("string"), F.lit(". "), title, F.lit("\n     "), F.col("why"), F.lit("\n     "), link)
    groups = F.concat(F.lit("  "), F.col("term"), F.lit("  "), F.col("current_count").cast("string"), F.lit(" groups"))
    parts = [
        delivery_lines(discovery.where("tier = 'first_appearance'"), 1, "New names, first appearance:", [F.desc("delta"), F.col("term")], 8, groups),
        delivery_lines(discovery.where("tier = 'bursting'"), 2, "New names, still bursting:", [F.desc("delta"), F.col("term")], 6, F.concat(groups, F.lit("  Δ"), signed(F.col("delta")))),
        delivery_lines(cross, 3, "Papers outside your field:", [F.col("rank")], 6, paper(F.concat(F.lit("["), F.coalesce(F.try_element_at("matched", F.lit(1)), F.lit("?")), F.lit("] "), F.col("title")))),
        delivery_lines(rising, 4, "Rising terms:", [F.desc("momentum"), F.desc("current"), F.col("term")], 8, F.concat(F.lit("  "), F.col("term"), F.lit("  Δ"), signed(F.col("momentum")), F.lit("  (now "), F.col("current").cast("string"), F.lit(")"))),
        delivery_lines(bursts, 5, "Bursts of tracked terms:", [F.desc("distinct_groups"), F.col("term")], 6, F.concat(F.lit("  "), F.col("term"), F.lit(" ("), F.col("distinct_groups").cast("string"), F.lit(" groups)"))),
        delivery_lines(broad, 6, "Papers in your field:", [F.col("rank")], 5, paper(F.concat(F.col("title"), F.lit("  "), F.col("badge")))),
        delivery_lines(niche, 7, "Niche:", [F.col("rank")], 6, F.concat(F.lit("  - "), F.col("title"), F.when(F.col("new_since_last_digest"), " *new*").otherwise(""), F.lit("\n    "), link)),
    ]
    quiet = broad.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(6).alias("part"), F.lit(0).alias("place"), F.lit("Papers in your field: a quiet week, nothing cleared the gate.\n").alias("line"))
    lines = head.unionByName(quiet)
    for p in parts:
        lines = lines.unionByName(p)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "place", "line"))), lambda x: x["line"])
    return lines.agg(F.rtrim(F.array_join(ordered, "\n")).alias("text")) if spark else lines


# Logs and markers.
def started(log: DataFrame, run_id: int, run_date: Column, kind: str, at: Column) -> DataFrame:
    """The run log with a new open run."""
    spark = log.sparkSession
    row = spark.range(1).select(F.lit(run_id).cast("bigint").alias("id"), run_date.alias("run_date"), F.lit(kind).alias("kind"), F.lit("running").alias("status"), at.alias("started_at"))
    return log.unionByName(row, allowMissingColumns=True)


def finished(log: DataFrame, run_id: int, status: str, at: Column, stats: str = "{}", errors: str = "[]") -> DataFrame:
    own = F.col("id") == run_id
    put = lambda c, v: F.when(own, v).otherwise(F.col(c))
    return log.withColumns({"status": put("status", F.lit(status)), "finished_at": put("finished_at", at), "stats": put("stats", F.lit(stats)), "errors": put("errors", F.lit(errors))})


def reap(log: DataFrame, as_of: Column, minutes: int = 25) -> DataFrame:
    """Runs still open after so many minutes end in error."""
    late = (F.col("status") == "running") & (F.col("started_at") < as_of - F.make_dt_interval(mins=F.lit(minutes)))
    return log.withColumns({"status": F.when(late, "error").otherwise(F.col("status")), "finished_at": F.when(late, as_of).otherwise(F.col("finished_at"))})


def no_recent_success(log: DataFrame, as_of: Column, hours: int = 26) -> DataFrame:
    """(last_ok, stale): the last good daily or manual run, and whether it is more than ``hours`` old; stale is null if there never was one."""
    last = log.where(F.col("kind").isin("daily", "manual") & (F.col("status") == "ok")).agg(F.max("finished_at").alias("last_ok"))
    return last.withColumn("stale", F.col("last_ok") < as_of - F.make_dt_interval(hours=F.lit(hours)))


def claim(markers: DataFrame, marker: str) -> tuple[DataFrame, bool]:
    """(markers with ``marker``, whether it is new): what must happen once happens when it is."""
    if not markers.where(F.col("marker") == marker).isEmpty():
        return markers, False
    row = markers.sparkSession.createDataFrame([(marker,)], "marker string")
    return markers.unionByName(row, allowMissingColumns=True), True


# Configuration.
def seed_sync(vocab: DataFrame, seeds: DataFrame) -> DataFrame:
    """vocab with every seed (term, weight): a known term becomes a seed and keeps its weight."""
    new = seeds.select("term", F.col("weight").cast("float").alias("weight"), F.lit(True).alias("is_seed"))
    return upsert(vocab, new, ["term"], {"is_seed": "or"})


def edit_seeds(vocab: DataFrame, before: list[str], after: dict[str, float]) -> tuple[DataFrame, list[str]]:
    """(vocab, terms to backfill) after an edit: new terms become seeds with their weight, removed ones are no seeds but stay."""
    added = {t: w for t, w in after.items() if t not in before}
    gone = [t for t in before if t not in after]
    rows = vocab.withColumn("is_seed", F.col("is_seed") & ~F.col("term").isin(*gone)) if gone else vocab
    if added:
        new = vocab.sparkSession.createDataFrame([(t, float(w), True) for t, w in added.items()], "term string, weight float, is_seed boolean")
        rows = upsert(rows, new, ["term"], {"is_seed": "or", "weight": "new"})
    return rows, sorted(added)


def check_config(patch: dict) -> list[str]:
    """What is wrong with an edit; nothing is mended: lists of non-empty trimmed strings, categories, weights from 0 to 5."""
    wrong = []
    for name in ("niche_queries", "broad_categories", "open_problems", "seed_papers"):
        rows = patch.get(name, [])
        if not isinstance(rows, list) or any(not isinstance(x, str) or not x.strip() or x != x.strip() for x in rows):
            wrong.append(f"{name}: a list of trimmed, non-empty strings")
    if not patch.get("broad_categories"):
        wrong.append("broad_categories: at least one")
    seeds = patch.get("seed_vocab", {})
    if not isinstance(seeds, dict) or any(isinstance(w, bool) or not isinstance(w, (int, float)) or not 0 <= w <= 5 for w in seeds.values()):
        wrong.append("seed_vocab: weights from 0 to 5")
    return wrong


def fan_out(vocab: DataFrame, phrases: DataFrame, n: int = 8) -> DataFrame:
    """(query): niche phrases (phrase) and the ``n`` seeds of greatest weight, each once, sorted."""
    top = vocab.where("is_seed").orderBy(F.desc("weight"), "term").limit(n).select(F.col("term").alias("query"))
    return phrases.select(F.col("phrase").alias("query")).unionByName(top).distinct().orderBy("query")


def seed_papers(papers: DataFrame, seeds: DataFrame) -> DataFrame:
    """Papers that a seed (id) names by its preprint number or by its key."""
    by_number = papers.join(seeds.select(F.col("id").alias("arxiv_id")), "arxiv_id", "left_semi").select(*papers.columns)
    by_key = papers.join(seeds.select(F.concat(F.lit("arxiv:"), "id").alias("paper_id")), "paper_id", "left_semi").select(*papers.columns)
    return by_number.unionByName(by_key).dropDuplicates(["paper_id"])


def changed_anchors(anchors: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (anchor_kind, anchor_id, model_version, text) whose text is not embedded yet; the liked centroid always."""
    keys = ["anchor_kind", "anchor_id", "model_version", "text"]
    return wanted.where("anchor_kind <> 'liked_centroid'").join(anchors.select(*keys), keys, "left_anti").unionByName(wanted.where("anchor_kind = 'liked_centroid'"))


def parse_vector(text: Column) -> Column:
    """A vector kept as text (``[1,2]`` or ``{1,2}``); null if it is none."""
    return F.from_json(F.translate(text, "{}", "[]"), "array<float>")


# Lists that are read back.
def state(digests: DataFrame, vocab: DataFrame, suggestions: DataFrame, runs: DataFrame, discovery: DataFrame, cards: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """The tables of the overview, each capped and ordered: digest, staleness, vocab, suggestions, runs, discovery, working."""
    last = digests.agg(F.max("run_date").alias("last_run_date"))
    days = F.datediff(as_of, "last_run_date")
    day = discovery.agg(F.max("run_date").alias("run_date"))
    recent = cards.where((F.col("section") == "broad") & (F.col("rank") <= 10) & (F.col("run_date") > F.date_sub(as_of, 56)))
    from papyral.functions.weeks import iso_week

    judged = F.when(F.col("outcome").isNull() & (F.datediff(as_of, F.col("run_date")) >= 5), "ignored").otherwise(F.col("outcome"))
    working = recent.select(iso_week(F.col("run_date")).alias("week"), judged.alias("o")).groupBy("week").agg(F.count_if(F.col("o") == "liked").alias("liked"), F.count_if(F.col("o").isin("disliked", "muted")).alias("disliked"), F.count_if(F.col("o") == "ignored").alias("ignored"), F.count("*").alias("n"))
    return {
        "digest": digests.orderBy(F.desc("run_date")).limit(1),
        "staleness": last.select("last_run_date", days.alias("days_old"), F.coalesce(days > 2, F.lit(False)).alias("stale")),
        "vocab": vocab.orderBy(F.desc("is_seed"), F.desc("weight"), "term"),
        "suggestions": suggestions.where("status = 'pending'").orderBy(F.desc("created_at"), "id").limit(20),
        "runs": runs.orderBy(F.desc("id")).limit(8),
        "discovery": discovery.join(F.broadcast(day), "run_date", "left_semi").orderBy(F.desc(F.col("tier") == "first_appearance"), F.desc("delta"), "term").limit(30),
        "working": working.withColumn("precision", F.try_divide("liked", F.col("liked") + F.col("disliked") + F.col("ignored"))).orderBy("week"),
    }


def last_rows(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The newest ``n`` rows of a log or history."""
    return df.orderBy(F.desc(key)).limit(n)


# Backfills over landed pages.
def paged(rows: DataFrame, since: Column, page: int, start: int = 0, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(rows read, (cursor)): a feed in order of ``seq``, newest first, from ``start`` on, until a row older than ``since`` or ``most`` pages.

    cursor is the place to go on from, null when the feed is through.
    """
    end = start + page * most
    window = rows.where((F.col("seq") >= start) & (F.col("seq") < end))
    old = window.where(F.col("published_date") < since).agg(F.min("seq").alias("stop"))
    kept = window.crossJoin(F.broadcast(old)).where(F.col("stop").isNull() | (F.col("seq") < F.col("stop"))).drop("stop")
    left = rows.where(F.col("seq") >= end).limit(1).agg(F.count("*").alias("more"))
    return kept, old.crossJoin(left).select(F.when(F.col("stop").isNull() & (F.col("more") > 0), F.lit(end)).alias("cursor"))


def backfill_query(term: Column, kind: Column) -> Column:
    """The query of a backfill: a keyword in abstract or title, a query as it is."""
    return F.when(kind == "query", term).otherwise(F.concat(F.lit('abs:"'), term, F.lit('" OR ti:"'), term, F.lit('"')))
