"""Vocabulary life cycle, feedback, measurement, saved searches, clusters' identity, delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyral.functions import text as X
from papyral.functions import weeks as K
from papyral.operators.trends import paper_text

DECAY, PRUNE_BELOW, SILENT_WEEKS = 0.97, 0.15, 4
MAX_LEARNED, ADDS = 200, 6
IGNORE_AFTER_DAYS = 5


def decay(vocab: DataFrame, rate: float = DECAY) -> DataFrame:
    """Every weight times the rate, in 4-byte floats."""
    return vocab.withColumn("weight", (F.col("weight").cast("float") * F.lit(rate).cast("float")).cast("float"))


def prune(vocab: DataFrame, current_monday: Column, below: float = PRUNE_BELOW, silent: int = SILENT_WEEKS) -> DataFrame:
    """Without learned terms of little weight that were silent for weeks; never seen is silent; seeds stay."""
    weeks = F.datediff(current_monday, F.col("last_seen_monday")) / 7
    drop = ~F.col("is_seed") & (F.col("weight") < below) & (F.col("last_seen_monday").isNull() | (weeks >= silent))
    return vocab.where(~drop)


def candidate_terms(papers: DataFrame) -> DataFrame:
    """(term, n): papers that hold each phrase or coinage."""
    grams = F.array_union(X.bigrams(F.col("text")), X.acronyms(F.col("text")))
    return paper_text(papers).select(F.explode(grams).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def growth(feedback: DataFrame, papers: DataFrame, vocab: DataFrame, learned: int) -> tuple[DataFrame, DataFrame]:
    """((term, n, weight), feedback): at most six new terms from liked papers not processed yet, and the feedback with those flagged.

    Weight 1.0 if a term is in two or more of them, else 0.4; ``learned`` terms in all fill at most MAX_LEARNED places.
    """
    due = (F.col("verdict") == "liked") & ~F.coalesce("processed_for_vocab", F.lit(False))
    liked = papers.join(feedback.where(due).select("paper_id").distinct(), "paper_id", "left_semi")
    fresh = candidate_terms(liked).join(vocab.select("term"), "term", "left_anti")
    room = max(0, min(ADDS, MAX_LEARNED - learned))
    terms = fresh.orderBy(F.desc("n"), "term").limit(room).select("term", "n", F.when(F.col("n") >= 2, 1.0).otherwise(0.4).alias("weight"))
    return terms, feedback.withColumn("processed_for_vocab", F.coalesce("processed_for_vocab", F.lit(False)) | F.coalesce(due, F.lit(False)))


def suggestions(liked: DataFrame, tracked: DataFrame, pending: DataFrame, n: int = 10) -> DataFrame:
    """(term, n): phrases in two or more liked papers that are neither tracked nor pending."""
    rows = candidate_terms(liked).where("n >= 2").join(tracked.select("term"), "term", "left_anti").join(pending.select("term"), "term", "left_anti")
    return rows.orderBy(F.desc("n"), "term").limit(n)


def precision_at_k(cards: DataFrame, as_of: Column, k: int = 10, weeks: int = 8) -> DataFrame:
    """(week, liked, disliked, ignored, pending, n, precision) of the broad cards; shown five days without action is ignored."""
    rows = cards.where((F.col("section") == "broad") & (F.col("rank") <= k) & (F.col("run_date") > F.date_sub(as_of, 7 * weeks)))
    o = F.coalesce("outcome", F.lit(""))
    old = F.datediff(as_of, F.col("run_date")) >= IGNORE_AFTER_DAYS
    bucket = F.when(o == "liked", "liked").when(o.isin("disliked", "muted"), "disliked").when((o == "ignored") | old, "ignored").otherwise("pending")
    by = rows.select(K.iso_week(F.col("run_date")).alias("week"), bucket.alias("b")).groupBy("week").agg(*[F.count_if(F.col("b") == b).alias(b) for b in ("liked", "disliked", "ignored", "pending")], F.count("*").alias("n"))
    return by.withColumn("precision", F.round(F.try_divide(F.col("liked"), F.col("liked") + F.col("disliked") + F.col("ignored")), 3))


def working_series(cards: DataFrame) -> DataFrame:
    """(run_date, liked, disliked, ignored, shown, precision): precision over judged cards only."""
    by = cards.groupBy("run_date").agg(F.count_if(F.col("outcome") == "liked").alias("liked"), F.count_if(F.col("outcome").isin("disliked", "muted")).alias("disliked"), F.count_if(F.col("outcome") == "ignored").alias("ignored"), F.count("*").alias("shown"))
    return by.withColumn("precision", F.try_divide(F.col("liked"), F.col("liked") + F.col("disliked") + F.col("ignored")))


def lead_time(labels: DataFrame, papers: DataFrame, cards: DataFrame) -> DataFrame:
    """(paper_id, surfaced, lead_days, missed) of the papers labelled ``blew_up``: days from the day they were first seen to their first card."""
    shown = cards.groupBy("paper_id").agg(F.min("run_date").alias("surfaced"))
    blown = labels.where(F.col("label") == "blew_up").select("paper_id").distinct()
    rows = papers.select("paper_id", F.to_date("first_seen_at").alias("seen")).join(blown, "paper_id").join(shown, "paper_id", "left")
    return rows.select("paper_id", "surfaced", F.datediff("surfaced", "seen").alias("lead_days"), F.col("surfaced").isNull().alias("missed"))


def saved_search(papers: DataFrame, phrase: str, words: list[str], ids: list[str] = (), limit: int = 150) -> DataFrame:
    """(paper_id, day, matched_locally): all words at word borders, or the phrase anywhere, or a listed id; newest first."""
    low = F.lower(F.col("text"))
    every = F.lit(bool(words))
    for w in words:
        every = every & low.rlike(X.pattern(w))
    keep = every | F.col("text").ilike(f"%{phrase}%")
    if ids:
        keep = keep | F.col("paper_id").isin(*ids)
    rows = paper_text(papers.where(~F.coalesce("muted", F.lit(False)))).withColumn("matched_locally", every).where(keep)
    return rows.select("paper_id", F.coalesce("announce_date", F.col("first_seen_at").cast("date")).alias("day"), "matched_locally").orderBy(F.desc_nulls_last("day"), "paper_id").limit(limit)


def jaccard_matches(current: DataFrame, previous: DataFrame, least: float = 0.5) -> DataFrame:
    """(cluster, previous, jaccard): each current cluster's best earlier cluster, each earlier one given away once.

    Sets meet through their members, so no clusters-times-clusters comparison is made.
    """
    a, b = current.select("cluster", "member").distinct(), previous.select(F.col("cluster").alias("previous"), "member").distinct()
    na, nb = a.groupBy("cluster").agg(F.count("*").alias("na")), b.groupBy("previous").agg(F.count("*").alias("nb"))
    both = a.join(b, "member").groupBy("cluster", "previous").agg(F.count("*").alias("n")).join(na, "cluster").join(nb, "previous")
    rows = both.withColumn("jaccard", F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).where(F.col("jaccard") >= least)
    one = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("jaccard"), "previous"))
    other = F.row_number().over(W.partitionBy("previous").orderBy(F.desc("jaccard"), "cluster"))
    return rows.withColumn("a", one).where("a = 1").withColumn("b", other).where("b = 1").select("cluster", "previous", "jaccard")


def digest(cards: DataFrame) -> DataFrame:
    """(run_date, section, cards): the cards of a section as a JSON array in order of rank."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "paper_id", "outcome")))
    return cards.groupBy("run_date", "section").agg(F.to_json(rows).alias("cards"))


#: Characters of one delivered message.
MESSAGE = 3900


def chunks(text: Column, limit: int = MESSAGE) -> Column:
    """An array of messages of at most ``limit`` characters that together are the text: as many whole lines as fit, a longer line cut; [""] for none.

    Lines, with their ends, are cut into pieces that fit; a fold then fills one message after the other.
    """
    lines = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\n\r]*(?:\r\n|\n|\r)|[^\n\r]+"), F.lit(0))
    pieces = F.flatten(F.transform(lines, lambda line: F.regexp_extract_all(line, F.lit(rf"(?s).{{1,{limit}}}"), F.lit(0))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def fill(state: Column, piece: Column) -> Column:
        full = F.length(state["open"]) + F.length(piece) > limit
        done = F.when(full & (state["open"] != ""), F.array_append(state["done"], state["open"])).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(full, piece).otherwise(F.concat(state["open"], piece)).alias("open"))

    return F.aggregate(pieces, start, fill, lambda s: F.when((s["open"] != "") | (F.size(s["done"]) == 0), F.array_append(s["done"], s["open"])).otherwise(s["done"]))


def apply_feedback(feedback: DataFrame, batch: DataFrame, papers: DataFrame, cards: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(feedback, papers, cards) after a batch of verdicts: upserted, muted papers muted, cards of 30 days given the outcome."""
    new = batch.groupBy("paper_id").agg(F.max(F.struct("at", "verdict")).alias("m")).select("paper_id", F.col("m.verdict").alias("verdict"), F.lit(False).alias("processed_for_vocab"))
    kept = feedback.select("paper_id", "verdict", "processed_for_vocab").join(new.select("paper_id"), "paper_id", "left_anti").unionByName(new)
    said = new.select("paper_id", F.col("verdict").alias("__v"))
    muted = papers.join(said, "paper_id", "left").withColumn("muted", F.coalesce("muted", F.lit(False)) | F.coalesce(F.col("__v") == "muted", F.lit(False))).drop("__v")
    recent = F.col("run_date") >= F.date_sub(as_of, 30)
    marked = cards.join(said, "paper_id", "left").withColumn("outcome", F.when(recent & F.col("__v").isNotNull(), F.col("__v")).otherwise(F.col("outcome"))).drop("__v")
    return kept, muted, marked
