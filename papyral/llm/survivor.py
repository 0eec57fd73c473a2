"""Best representative of each duplicate group: one surviving record, field by field.

For the abstract: token-level consensus.  The values of a group are aligned progressively
(longest first) and every column is voted by the weight of its tokens; a value votes for a gap where it passes over a column
between its first and its last token, and casts no vote behind its end, as a cut payload says nothing about the words it
lacks.  The distance of a value to the consensus is the winning weight of all columns where it has not the voted
token (a gap costs the same), and the existing value closest to the consensus survives; ties go to the more trusted.

Messages that stand in for an abstract are told by votes as well, over the whole corpus: where two values of a group share
little wording, the one whose text stands so against others in more papers loses; a text that loses in LEAST_PAPERS papers
at least, and more often than it wins, is no abstract anywhere.

For the date: the most trusted source that gives a complete and real one.

All work on one row a (paper, source), the latest delivery; the latest is chosen by an
aggregate with a partial step before its shuffle, so a paper repeated a million times is no
hot group.  A group has at most as many values as there are sources.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyral.session import HEAVY, Scratch, spread_join, table

# Where each feed's payload holds the publication date (creation date for openreview).
DATE_FIELDS = {
    "arxiv": "$.published",
    "biorxiv": "$.date",
    "medrxiv": "$.date",
    "core": "$.publishedDate",
    "europepmc": "$.firstPublicationDate",
    "hf_daily": "$.publishedAt",
    "openalex": "$.publication_date",
    "s2": "$.publicationDate",
}
UNTRUSTED = 2**31 - 1

#: Texts that stand in for abstracts are broadcast up to so many; beyond, they are joined.
MAX_SHARED = 100_000
#: A stand-in loses against other values in at least so many papers.
LEAST_PAPERS = 2

HEADING_TAG = re.compile(r"<(jats:title|title|h[1-6]|b|strong)\b[^>]*>[^<]*</\1\s*>", re.I)
TAG = re.compile(r"<[^<>]*>")
HEADING = re.compile(r"^\s*(?:abstract|summary|background|objectives?|introduction)\s*[:.\-–—]\s*", re.I)
RIGHTS = re.compile(r"\s*(?:\(c\)|©|copyright)\s*(?:\(c\)|©)?\s*\d{4}\b.{0,120}$|\s*all rights reserved\.?\s*$", re.I | re.S)
CUT = re.compile(r"\s*(?:\[?(?:\.\.\.|…)\]?)\s*$")
# Where neither is, the slow patterns find nothing; the odd letters are i and s to a pattern that knows no case.
RIGHTS_WORDS, ODD_LETTERS, CUT_ENDS = ("(c)", "©", "copyright", "all rights reserved"), "ıİſ", ("...", "…", "...]", "…]")


def real_words(text: str | None) -> list[str]:
    """The words of ``text`` without markup, headings and rights notices."""
    if not text:
        return []
    if "<" in text:
        text = TAG.sub(" ", HEADING_TAG.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    low = text.lower()
    if any(w in low for w in RIGHTS_WORDS) or (not text.isascii() and any(c in text for c in ODD_LETTERS)):
        text = RIGHTS.sub("", text)
    text = HEADING.sub("", text)
    if text.rstrip().endswith(CUT_ENDS):
        text = CUT.sub("", text)
    return [w for w in text.split() if w[0].isalnum() or any(map(str.isalnum, w))]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of two token lists, rising in both.

    Equal ends are matched, then the tokens that occur once in either list, as far as they are in one order (a longest
    rising run); between two of those the same again.  Of n tokens, n log n steps for texts of any length.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        once_a, once_b = _once(a, i, n), _once(b, j, m)
        pairs = sorted((p, once_b[t]) for t, p in once_a.items() if t in once_b)
        anchors = _rising(pairs)
        low = (i, j)
        for p, q in anchors:
            todo.append((low[0], p, low[1], q))
            out.append((p, q))
            low = (p + 1, q + 1)
        if anchors:
            todo.append((low[0], n, low[1], m))
    return sorted(out)


def _once(tokens: list[str], low: int, high: int) -> dict[str, int]:
    seen: dict[str, int] = {}
    for k in range(low, high):
        seen[tokens[k]] = -1 if tokens[k] in seen else k
    return {t: k for t, k in seen.items() if k >= 0}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, sorted by their first number, that rises in the second."""
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, q) in enumerate(pairs):
        n = bisect_left(ends, q)
        before.append(at[n - 1] if n else -1)
        if n == len(ends):
            ends.append(q)
            at.append(k)
        else:
            ends[n], at[n] = q, k
    out = []
    k = at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


GAP = None


def consensus(values: list[list[str]], weights: list[float]) -> tuple[list[str], list[float]]:
    """The consensus tokens of ``values`` and each value's distance to it.

    Progressive alignment, longest value first (ties: as given), against the tokens voted so far.
    """
    order = sorted(range(len(values)), key=lambda i: -len(values[i]))
    if order and one_text(values):  # every column has one token: the vote is each one's weight
        away = [0.0] * len(values)
        weight = sum(weights)
        ends = sorted(order, key=lambda i: len(values[i]))
        total = [0.0]  # what the columns up to each end weigh, from the first end on
        for a, b in zip(ends, ends[1:]):
            weight -= weights[a]
            total.append(total[-1] + weight * (len(values[b]) - len(values[a])))
        for i, t in zip(ends, total):
            away[i] = total[-1] - t
        return [t.casefold() for t in values[order[0]]], away
    columns: list[dict[int, str]] = []  # value -> token
    voted: list[str] = []
    for i in order:
        tokens = [t.casefold() for t in values[i]]
        if not columns:
            columns, voted = [{i: t} for t in tokens], tokens
        elif tokens == voted[: len(tokens)]:
            for c, t in zip(columns, tokens):
                c[i] = t
        else:  # a column that gets one more of the token it voted, or nothing, votes as before
            merged: list[dict[int, str]] = []
            votes: list[str] = []
            p = q = 0
            for x, y in [*align(voted, tokens), (len(voted), len(tokens))]:
                # Between two matches the columns are paired off; what is left over is an insertion on either side.
                while p < x or q < y:
                    c = columns[p] if p < x else {}
                    if q < y:
                        c[i] = tokens[q]
                    merged.append(c)
                    votes.append(voted[p] if q >= y else _plurality(c, weights)[0] if p < x else tokens[q])
                    p, q = min(p + 1, x), min(q + 1, y)
                if x < len(voted) and y < len(tokens):
                    columns[x][i] = tokens[y]
                    merged.append(columns[x])
                    votes.append(voted[x])
                    p, q = x + 1, y + 1
            columns, voted = merged, votes
    if all(len(c) == len(values) and len(set(c.values())) == 1 for c in columns):
        return voted, [0.0] * len(values)
    # Where each value begins and ends: it votes for a gap only between.
    span = {}
    for k, c in enumerate(columns):
        for i in c:
            span[i] = (span[i][0] if i in span else k, k)
    result, away = [], [0.0] * len(values)
    for k, c in enumerate(columns):
        ballot: dict[int, str | None] = dict(c)
        for i, (low, high) in span.items():
            if i not in c and low < k < high:
                ballot[i] = GAP
        winner, weight = _plurality(ballot, weights)
        if winner is not GAP:
            result.append(winner)
        for i in range(len(values)):
            if c.get(i) != winner:
                away[i] += weight
    return result, away


def one_text(values: list[list[str]]) -> bool:
    """Whether every value is the beginning of the longest."""
    longest = max(values, key=len)
    return all(v == longest[: len(v)] for v in values)


def _plurality(ballot: dict, weights: list[float]) -> tuple[str | None, float]:
    """The token (or GAP) of greatest weight and that weight; ties: a token before a gap, then by code point."""
    sums: dict = {}
    for i, t in ballot.items():
        sums[t] = sums.get(t, 0.0) + weights[i]
    if len(sums) == 1:
        return next(iter(sums.items()))
    best = max(sums, key=lambda t: (sums[t], t is not GAP, t or ""))
    return best, sums[best]


def opposed(values: list[list[str]]) -> set[tuple[int, int]]:
    """(code, other's code) of the values that others stand against: that share fewer than half of the shorter one's words.

    A value that a further, not identical value bears out by sharing more has no row of its own.
    """
    if not values or one_text(values):
        return set()
    kinds = {_code(v): {t.casefold() for t in v} for v in values}
    out = set()
    for x, a in kinds.items():
        shares = {y: 2 * len(a & b) >= min(len(a), len(b)) for y, b in kinds.items() if y != x}
        if not any(shares.values()):
            out.update((x, y) for y in shares)
    return out


def _code(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words).casefold()) - (1 << 63)


def _payload(raw: Column, source: Column) -> tuple[Column, Column]:
    """(abstract text, date) of a payload; null where the JSON is broken or lacks it."""
    v = F.try_parse_json(raw)
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    inverted = get("$.abstract_inverted_index", "map<string,array<int>>")
    placed = F.array_sort(F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))))))
    rebuilt = F.array_join(F.transform(placed, lambda x: x["w"]), " ")
    nested = F.coalesce(get("$.content.abstract.value"), get("$.content.abstract"))
    text = F.when(source == "openalex", F.coalesce(rebuilt, get("$.abstract"))).when(source == "openreview", nested)
    text = text.otherwise(F.coalesce(get("$.summary"), get("$.abstractText"), get("$.abstract")))
    written = F.lit(None).cast("string")
    for name, path in DATE_FIELDS.items():
        written = F.when(source == name, get(path)).otherwise(written)
    written = F.trim(written)
    slashed = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    parts = get("$.published['date-parts'][0]", "array<int>")
    ymd = F.when(written.rlike(r"^\d{4}-\d{1,2}-\d{1,2}(?:$|[T ])"), F.regexp_extract(written, r"^(\d{4}-\d{1,2}-\d{1,2})", 1))
    ymd = ymd.when(written.rlike(slashed), F.regexp_replace(written, slashed, "$3-$2-$1"))
    ymd = ymd.when((source == "crossref") & (F.size(parts) == 3), F.array_join(parts, "-"))
    millis = F.when(source == "openreview", get("$.cdate", "bigint"))
    date = F.when(millis.isNotNull(), F.timestamp_millis(millis).cast("date")).otherwise(ymd.try_cast("date"))
    return text, date


def latest_payloads(sources: DataFrame) -> DataFrame:
    """(paper_id, source, abstract, date): the latest row of each paper and source, its payload read.

    At one first_seen_at the larger payload by code point counts; a null first_seen_at is older than any.  A date
    counts if it is from 1990-01-01 to the day of first_seen_at.  Rows with a null paper_id or source are left out.
    """
    text, date = _payload(F.col("raw"), F.col("source"))
    # first_seen_at decides, so only repeats at one instant compare payloads.
    latest = (
        sources.where(F.col("paper_id").isNotNull() & F.col("source").isNotNull())
        .groupBy("paper_id", "source")
        .agg(F.max(F.struct(F.col("first_seen_at"), F.col("raw"))).alias("m"))
        .select("paper_id", "source", F.col("m.first_seen_at").alias("first_seen_at"), F.col("m.raw").alias("raw"))
    )
    real = date.between(F.lit("1990-01-01").cast("date"), F.to_date("first_seen_at"))
    return latest.select("paper_id", "source", text.alias("abstract"), F.when(real, date).alias("date"))


def survivors(sources: DataFrame, trust: DataFrame, least: int = 1) -> DataFrame:
    """(paper_id, n_sources, abstract, abstract_source, announce_date, date_source), one row a paper of ``least`` sources or more.

    ``abstract`` is the existing value closest to the consensus of the group's values, as delivered; null and
    source '' where no payload has a real abstract.  ``announce_date`` is that of the most trusted source with a usable
    date; null and '' where there is none.  Sources that ``trust`` lacks come last, in order of name.

    A group is read once: its survivor, and what stands against what.  Only groups in which a stand-in turns up, which is known
    when all are read, are voted again.
    """
    ranked = latest_payloads(sources).join(trust.groupBy(F.col("source")).agg(F.min("trust_rank").alias("trust_rank")), "source", "left")
    ranked = ranked.withColumn("trust_rank", F.coalesce(F.col("trust_rank").cast("int"), F.lit(UNTRUSTED)))
    groups = ranked.groupBy("paper_id").agg(
        F.count("*").alias("n_sources"),
        F.min(F.when(F.col("date").isNotNull(), F.struct("trust_rank", "source", "date"))).alias("d"),
        F.collect_list(F.struct("trust_rank", "source", "abstract")).alias("values"),
    )
    scratch = Scratch(sources.sparkSession, "survivors")
    # The values in order of trust; a group of one source stands against nothing, so those below ``least`` say nothing of others.
    values = F.transform(F.array_sort(F.filter("values", lambda g: g["abstract"].isNotNull())), lambda g: F.struct(g["trust_rank"].alias("trust_rank"), g["source"].alias("source"), g["abstract"].alias("abstract")))
    flat = groups.where(F.col("n_sources") >= least).select("paper_id", "n_sources", F.col("d.date").alias("announce_date"), F.coalesce("d.source", F.lit("")).alias("date_source"), values.alias("values"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, texts, ends = _flat(batch.column(4))
            codes, places, xs, ys = [], [], [], []
            for low, high in ends:
                group = [real_words(t) for t in texts[low:high]]
                own = [_code(w) if w else None for w in group]
                against = opposed([w for w in group if w]) if len(set(own) - {None}) > 1 else ()
                codes.append(own)
                places.append(_best(group, ranks[low:high]))
                xs.append([x for x, _ in against])
                ys.append([y for _, y in against])
            lists = [pa.array(c, pa.list_(pa.int64())) for c in (codes, xs, ys)]
            yield pa.RecordBatch.from_arrays([*batch.columns, lists[0], pa.array(places, pa.int32()), *lists[1:]], names=[*batch.schema.names, "codes", "best", "x", "y"])

    kept = "paper_id string, n_sources bigint, announce_date date, date_source string"
    voted = scratch.save(flat.mapInArrow(read, f"{kept}, values array<struct<trust_rank int, source string, abstract string>>, codes array<bigint>, best int, x array<bigint>, y array<bigint>"), "groups")
    against = voted.where(F.size("x") > 0).select(F.inline(F.arrays_zip("x", "y")))
    against = scratch.save(against.groupBy("x", "y").agg(F.count("*").alias("n")), "against")
    often = scratch.save(against.groupBy("x").agg(F.sum("n").alias("often"), F.count("*").alias("rows")), "often")
    heavy = [r["x"] for r in often.where(F.col("rows") >= F.greatest(F.lit(1000), F.lit(HEAVY) * against.count())).select("x").collect()]
    both = spread_join(against, often.select("x", "often"), "x", heavy)
    other = against.select(F.col("y").alias("x")).distinct().join(often, "x", "left").select(F.col("x").alias("y"), F.coalesce("often", F.lit(0)).alias("other"))
    both = spread_join(both, other, "y", heavy)
    judged = both.groupBy("x").agg(F.sum(F.when(F.col("often") > F.col("other"), F.col("n"))).alias("lost"), F.sum(F.when(F.col("often") < F.col("other"), F.col("n"))).alias("won"))
    stand_ins = judged.where((F.col("lost") >= LEAST_PAPERS) & (F.col("lost") > F.coalesce("won", F.lit(0)))).select(F.col("x").alias("code"))
    empty = scratch.save(stand_ins, "stand_ins")

    def again(batches: Iterator[pa.RecordBatch], barred) -> Iterator[pa.RecordBatch]:
        """(..., best) of groups with their values, codes and best; voted without stand-ins: the set ``barred``, or each row's own."""
        for batch in batches:
            every, best = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            own = batch.column(7).to_pylist() if batch.num_columns > 7 else None
            for k, codes in enumerate(every):
                none = barred if own is None else set(own[k] or ())
                if none.isdisjoint(codes):
                    continue
                group = batch.column(4)[k].as_py()
                words = [real_words(g["abstract"]) if c not in none else [] for g, c in zip(group, codes)]
                best[k] = _best(words, [g["trust_rank"] for g in group])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(best, pa.int32())], names=[*batch.schema.names[:5], "best"])

    columns = voted.select("paper_id", "n_sources", "announce_date", "date_source", "values", "codes", "best")
    schema = f"{kept}, values array<struct<trust_rank int, source string, abstract string>>, best int"
    spark = sources.sparkSession
    if empty.count() <= MAX_SHARED:
        shared = spark.sparkContext.broadcast(frozenset(r["code"] for r in empty.collect()))
        final = columns.mapInArrow(lambda batches: again(batches, shared.value), schema)
    else:
        hit = columns.select("paper_id", F.explode("codes").alias("code")).join(empty, "code").groupBy("paper_id").agg(F.collect_set("code").alias("barred"))
        final = columns.join(hit, "paper_id", "left").mapInArrow(lambda batches: again(batches, frozenset()), schema)
    chosen = F.try_element_at("values", F.col("best") + 1)
    return final.withColumn("c", chosen).select("paper_id", "n_sources", "announce_date", "date_source", F.col("c.abstract").alias("abstract"), F.coalesce("c.source", F.lit("")).alias("abstract_source"))


def _flat(column: pa.Array) -> tuple[list[int], list[str], list[tuple[int, int]]]:
    """The ranks and texts of a column of lists of values, and where each list begins and ends."""
    at = column.offsets.to_pylist()
    values = column.values
    return values.field(0).to_pylist(), values.field(2).to_pylist(), list(zip(at, at[1:]))


def _best(values: list[list[str]], ranks: list[int]) -> int | None:
    """The place of the value closest to the consensus, of those that have words; null if none has.  ``values`` are in order of trust."""
    places = [i for i, v in enumerate(values) if v]
    if len(places) < 2:
        return places[0] if places else None
    _, away = consensus([values[i] for i in places], [1.0 / (1.0 + ranks[i]) for i in places])
    return min(zip(places, away), key=lambda p: (round(p[1], 9), p[0]))[0]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = survivors(table(spark, sf_dir, "paper_sources"), table(spark, sf_dir, "source_trust"), least=2)
    return out.select("paper_id", "abstract_source", "date_source")


def best_dates(sources: DataFrame, trust: DataFrame) -> DataFrame:
    """(paper_id, announce_date, date_source) of every paper: the date of the most trusted source that gives a real one; null and '' if none does."""
    ranked = latest_payloads(sources).join(trust.groupBy("source").agg(F.min("trust_rank").alias("trust_rank")), "source", "left")
    rank = F.coalesce(F.col("trust_rank").cast("int"), F.lit(UNTRUSTED))
    best = ranked.groupBy("paper_id").agg(F.min(F.when(F.col("date").isNotNull(), F.struct(rank.alias("r"), "source", "date"))).alias("d"))
    return best.select("paper_id", F.col("d.date").alias("announce_date"), F.coalesce("d.source", F.lit("")).alias("date_source"))


def p3_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_dates(table(spark, sf_dir, "paper_sources"), table(spark, sf_dir, "source_trust"))
