"""Landed feed files as rows of one shape (a job outside Spark fetches them).

A feed is a function (DataFrame with a string column ``raw``, one JSON record a row) -> (source, source_id, title,
abstract, authors, doi, arxiv_id, published_date, url).  Broken JSON and missing fields give nulls, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyral.functions import text as X


def get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("__v"), path, kind)


def day(text: Column) -> Column:
    """A date written in full; null for anything else."""
    return F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1).try_cast("date")


def inverted_text(index: Column) -> Column:
    """The text of a map word -> positions; of two words at one position the last by word counts; null if empty."""
    flat = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(flat), lambda x: x["w"]), " "), F.lit(""))


def parts(path: str) -> Column:
    """A date of ``[year, month, day]`` with 1 for what is missing."""
    p = get(path, "array<int>")
    at = lambda i: F.coalesce(F.try_element_at(p, F.lit(i)), F.lit(1)).cast("string")
    return F.when(F.try_element_at(p, F.lit(1)).isNotNull(), F.concat_ws("-", F.try_element_at(p, F.lit(1)).cast("string"), F.lpad(at(2), 2, "0"), F.lpad(at(3), 2, "0")).try_cast("date"))


NONE, NAMES = F.lit, "array<string>"


def _feed(source: str, **columns):
    def read(df: DataFrame) -> DataFrame:
        rows = df.withColumn("__v", F.try_parse_json("raw"))
        null = F.lit(None)
        made = {k: f() for k, f in columns.items()}
        out = [F.lit(source).alias("source")]
        for name, kind in (("source_id", "string"), ("title", "string"), ("abstract", "string"), ("authors", NAMES), ("doi", "string"), ("arxiv_id", "string"), ("published_date", "date"), ("url", "string")):
            out.append(made.get(name, null).cast(kind).alias(name))
        return rows.select(*out)

    return read


def _names(path: str, field: str):
    return lambda: F.transform(get(path, f"array<struct<{field}:string>>"), lambda a: a[field])


FEEDS = {
    "hf_daily": _feed("hf_daily", source_id=lambda: get("$.paper.id"), title=lambda: F.coalesce(get("$.paper.title"), get("$.title")), abstract=lambda: F.coalesce(get("$.paper.summary"), get("$.summary")), arxiv_id=lambda: get("$.paper.id"), authors=_names("$.paper.authors", "name"), published_date=lambda: day(F.coalesce(get("$.publishedAt"), get("$.paper.publishedAt")))),
    "biorxiv": _feed("biorxiv", source_id=lambda: get("$.doi"), title=lambda: get("$.title"), abstract=lambda: get("$.abstract"), doi=lambda: get("$.doi"), authors=lambda: F.transform(F.split(get("$.authors"), ";"), lambda a: F.trim(a)), published_date=lambda: day(get("$.date"))),
    "crossref": _feed("crossref", source_id=lambda: get("$.DOI"), title=lambda: F.coalesce(F.array_join(get("$.title", NAMES), " "), get("$.title")), abstract=lambda: X.strip_tags(get("$.abstract")), doi=lambda: get("$.DOI"), published_date=lambda: parts("$.published['date-parts'][0]"), url=lambda: get("$.URL")),
    "openalex": _feed("openalex", source_id=lambda: get("$.id"), title=lambda: get("$.title"), abstract=lambda: inverted_text(get("$.abstract_inverted_index", "map<string,array<int>>")), doi=lambda: F.regexp_replace(get("$.doi"), r"^https?://doi\.org/", ""), published_date=lambda: day(get("$.publication_date"))),
    "s2": _feed("s2", source_id=lambda: get("$.paperId"), title=lambda: get("$.title"), abstract=lambda: get("$.abstract"), doi=lambda: get("$.externalIds.DOI"), arxiv_id=lambda: get("$.externalIds.ArXiv"), authors=_names("$.authors", "name"), published_date=lambda: F.coalesce(day(get("$.publicationDate")), F.concat(get("$.year"), F.lit("-01-01")).try_cast("date"))),
    "core": _feed("core", source_id=lambda: get("$.id"), title=lambda: get("$.title"), abstract=lambda: get("$.abstract"), doi=lambda: get("$.doi"), authors=_names("$.authors", "name"), published_date=lambda: F.coalesce(day(get("$.publishedDate")), day(get("$.depositedDate")), day(get("$.createdDate")))),
    "dblp": _feed("dblp", source_id=lambda: get("$.info.key"), title=lambda: F.regexp_replace(F.coalesce(get("$.info.title"), get("$.title")), r"\.$", ""), authors=lambda: F.coalesce(F.transform(get("$.info.authors.author", "array<struct<text:string>>"), lambda a: a["text"]), F.array(get("$.info.authors.author.text"))), doi=lambda: get("$.info.doi"), published_date=lambda: F.concat(get("$.info.year"), F.lit("-01-01")).try_cast("date")),
    "europepmc": _feed("europepmc", source_id=lambda: get("$.id"), title=lambda: F.regexp_replace(get("$.title"), r"\.+$", ""), abstract=lambda: X.strip_tags(get("$.abstractText")), doi=lambda: get("$.doi"), published_date=lambda: day(get("$.firstPublicationDate"))),
    "openreview": _feed("openreview", source_id=lambda: get("$.id"), title=lambda: F.coalesce(get("$.content.title.value"), get("$.content.title")), abstract=lambda: F.coalesce(get("$.content.abstract.value"), get("$.content.abstract")), authors=lambda: F.array().cast(NAMES), published_date=lambda: F.timestamp_millis(get("$.cdate", "bigint")).cast("date")),
}
FEEDS["medrxiv"] = lambda df: FEEDS["biorxiv"](df).withColumn("source", F.lit("medrxiv"))


def arxiv_entries(spark: SparkSession, path: str) -> DataFrame:
    """Landed Atom files, one row an entry: the id without version, white space collapsed."""
    schema = "id string, title string, summary string, published string, author array<struct<name:string>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    number = F.regexp_replace(F.regexp_extract("id", r"abs/(.+)$", 1), r"v\d+$", "")
    return rows.select(F.lit("arxiv").alias("source"), number.alias("source_id"), X.normalize_ws(F.col("title")).alias("title"), X.normalize_ws(F.col("summary")).alias("abstract"), F.transform("author", lambda a: a["name"]).alias("authors"), F.lit(None).cast("string").alias("doi"), number.alias("arxiv_id"), day(F.col("published")).alias("published_date"), F.col("id").alias("url"))


def keyword_filter(rows: DataFrame, words: list[str]) -> DataFrame:
    """Rows with any keyword in title or abstract, in any case; no keywords keep all."""
    if not words:
        return rows
    low = F.lower(F.concat_ws(" ", "title", "abstract"))
    keep = F.lit(False)
    for w in words:
        keep = keep | low.contains(w.lower())
    return rows.where(keep)


def enabled(flags: dict[str, bool]) -> dict:
    """The feeds that the configuration switches on."""
    return {k: f for k, f in FEEDS.items() if flags.get(k, False)}
