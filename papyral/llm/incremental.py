"""Deduplicating new batches against all history, through an index of fingerprints.

The index is a folder of lasting tables hashed into buckets: block tables (key, title, letters), titles, the people
of each title, and links.  A delivery is looked up there: exact identifier, exact normalised title, exact block match
followed by a check of the letters, of the Hamming distance and of the text.  Then its new titles, and new people of known ones, are
appended.  Only keys of the delivery are shuffled; history is read bucket by bucket where it lies, and never
compared with itself again.  Any split of the same rows into deliveries gives the same works.

Titles that are equal after normalisation are one entry, so a work delivered a million times is one entry too, and block
tables hold distinct titles only.  A title belongs to its first record; a later record of the same title by other people
(no name word in common, one letter aside, unless one side names nobody) is another work of that title.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyral.llm.components import connected_components
from papyral.llm.works import NAMED, alike, block_keys, like_letters, of_same_people, same_titles, work_features
from papyral.session import Buckets, Scratch, table, trim_driver

#: Rows of history that one bucket is meant for.
BUCKET_ROWS = 100_000
#: Type of a delivery's number.  Generated code holds an integer as text, so every delivery's would be compiled, and run cold, anew.
NUMBER = "decimal(9,0)"


def _words(people: str) -> Column:
    return F.when(F.col(people) == "", F.array().cast("array<string>")).otherwise(F.split(people, " "))


def _strange(words: str, first: str) -> Column:
    """Whether both sides name somebody and no word of one is a word of the other, one letter (or two swapped) aside."""
    letters = lambda w: F.array_join(F.array_sort(F.split(w, "")), "")
    slip = lambda w, v: (F.levenshtein(w, v, 1) >= 0) | ((F.length(w) == F.length(v)) & (F.levenshtein(w, v, 2) >= 0) & (letters(w) == letters(v)))
    near = F.exists(words, lambda w: (F.length(w) >= 5) & F.exists(first, lambda v: (F.length(v) >= 5) & slip(w, v)))
    return (F.size(words) > 0) & (F.size(first) > 0) & ~F.arrays_overlap(words, first) & ~near


def _other() -> Column:
    """The vertex of a stranger to a title."""
    return F.xxhash64(F.lit("by"), "title", "people")


def _placed(features: DataFrame, strange: DataFrame) -> DataFrame:
    """features with their ``vertex``."""
    marked = features.join(strange.withColumn("stranger", F.lit(True)), ["title", "people"], "left")
    return marked.withColumn("vertex", F.coalesce(F.when(F.col("stranger"), _other()), F.col("title"), F.xxhash64(F.lit("row"), F.col("id"))))


class FingerprintIndex:
    """History as tables in ``folder``; a later session that opens the same folder goes on where the last one ended.

    titles (title, tokens, words, first): a row with the tokens and the first record's name words for each title, further
    rows for words that later records of its own work bring; blocks (key, title, letters): the rotated block tables; links
    (u, v, kind): what ties vertices, for certain or (kind ``near``) by like text; strangers (title, people): records of a
    title that are another work; each row with the number ``n`` of its delivery.  Vertices are 64-bit hashes of titles,
    of strangers, of identifiers, and of rows without a title.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 12):
        self.spark, self.scratch = spark, Scratch(spark, "index")
        folder = (folder or f"{self.scratch.root}/tables").rstrip("/")
        made = lambda name, schema, key: Buckets(spark, f"{folder}/{name}", f"{schema}, n {NUMBER}", key, buckets)
        self.titles = made("titles", "title bigint, tokens string, print bigint, letters bigint, tables int, words array<string>, first boolean", "title")
        self.blocks = made("blocks", "key bigint, title bigint, letters bigint", "key")
        self.links = made("links", "u bigint, v bigint, kind string, people string", "u")
        self.n = max(int(t.read().agg(F.max("n")).first()[0] or 0) for t in (self.titles, self.links))
        self.done, self.known_works = 0, None

    def append(self, features: DataFrame) -> None:
        """Look a delivery up in the index and add it.

        features: what :func:`work_features` makes of its rows, as a written table.  :meth:`vertices` places the rows.
        """
        self.n += 1
        number = self._number().alias("n")
        titled = features.where(F.col("title").isNotNull())
        classes = titled.groupBy("title", "people").agg(F.min("id").alias("id"), F.min("tokens").alias("tokens"), F.min("print").alias("print"), F.min("letters").alias("letters"), F.min("tables").alias("tables"))
        by_first = W.partitionBy("title").orderBy("id", "people")
        # Placed as the buckets are, so that what is known of the titles joins them where it is read.
        classes = self.titles.placed(classes).withColumn("batch_first", F.first("people").over(by_first))
        # History is read bucket by bucket; what is built in memory and shuffled is the delivery's side.
        known = self.titles.read().join(titled.select("title").hint("shuffle_hash"), "title", "left_semi").groupBy("title")
        known = known.agg(F.flatten(F.collect_list("words")).alias("known"), F.flatten(F.collect_list(F.when(F.col("first"), F.col("words")))).alias("known_first"))
        met = classes.join(known.hint("shuffle_hash"), "title", "left").select("title", "people", "tokens", "print", "letters", "tables", _words("people").alias("words"), F.coalesce("known_first", _words("batch_first")).alias("first"), "known", F.col("known").isNotNull().alias("old"))
        met = self.scratch.save(met.withColumn("stranger", _strange("words", "first")), "met")
        # Words that the title's own work has not shown before make new keys; a new title makes all of its keys.
        union = F.array_sort(F.array_distinct(F.flatten(F.collect_set("words"))))
        fresh = self.titles.placed(met.where(~F.col("stranger"))).groupBy("title").agg(*[F.max(c).alias(c) for c in ("tokens", "print", "letters", "tables", "old", "first", "known")], union.alias("words"))
        row = lambda tokens, tables, words, first: F.struct(tokens.alias("tokens"), tables.alias("tables"), words.alias("words"), F.lit(first).alias("first"))
        named, untold = F.col("tables").bitwiseAND(F.lit(NAMED)), F.lit(None).cast("string")
        new = F.array(row(F.col("tokens"), F.col("tables"), F.col("first"), True), row(untold, named, F.array_except("words", "first"), False))
        more = F.array(row(untold, named, F.array_except("words", "known"), False))
        rows = fresh.select("title", "print", "letters", F.inline(F.when(F.col("old"), more).otherwise(new))).where(F.col("first") | (F.size("words") > 0))
        self.titles.append(rows.select("title", "tokens", "print", "letters", "tables", "words", "first", number), placed=True)
        fresh = self.titles.read().where(F.col("n") == self._number())
        self.blocks.append(block_keys(fresh, F.col("words"), "title", "letters").select("key", "title", "letters", number))
        blocks = self.blocks.read()
        a = blocks.where(F.col("n") == self._number()).select("key", F.col("title").alias("u"), F.col("letters").alias("letters_u"))
        b = blocks.select("key", F.col("title").alias("v"), F.col("letters").alias("letters_v"))
        # Titles of common words meet by the square of their number: what their letters tell apart is neither shuffled nor looked up.
        pairs = a.hint("shuffle_hash").join(b, "key").where((F.col("u") != F.col("v")) & like_letters("letters_u", "letters_v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        pairs = self.titles.placed(pairs, "u").dropDuplicates(["u", "v"])
        side = lambda n: self.titles.read().where(F.col("first")).select(F.col("title").alias(n), F.col("tokens").alias(f"tokens_{n}"), F.col("print").alias(f"print_{n}"))
        both = side("v").join(side("u").join(pairs.hint("shuffle_hash"), "u").hint("shuffle_hash"), "v")
        nothing = F.lit(None).cast("string").alias("people")
        near = same_titles(both.where(alike("print_u", "print_v"))).select("u", "v", F.lit("near").alias("kind"), nothing)
        # Certain ties: identifiers, and the name words by which records of one title find each other.
        strange = met.where("stranger").select("title", "people")
        code = lambda kind: F.when(F.col(kind).isNotNull(), F.xxhash64(F.lit(kind), F.col(kind)))
        ids = _placed(features.where("doi IS NOT NULL OR arxiv IS NOT NULL"), strange).select(F.col("vertex").alias("u"), F.explode(F.array(code("doi"), code("arxiv"))).alias("v")).where(F.col("v").isNotNull())
        by_word = met.select("title", F.when(F.col("stranger"), _other()).otherwise(F.col("title")).alias("u"), F.explode(F.when(F.col("stranger"), F.col("words")).otherwise(F.array_except("words", "first"))).alias("w"))
        sure = ids.unionByName(by_word.select("u", F.xxhash64(F.lit("of"), "title", "w").alias("v"))).distinct().select("u", "v", F.lit("sure").alias("kind"), nothing)
        others = strange.select(F.col("title").alias("u"), _other().alias("v"), F.lit("stranger").alias("kind"), "people")
        self.links.append(near.unionByName(sure).unionByName(others).select("u", "v", "kind", "people", number))
        self.scratch.drop(met)

    def _number(self) -> Column:
        return F.lit(Decimal(self.n)).cast(NUMBER)

    def strangers(self) -> DataFrame:
        """(title, people) of the records that are another work of their title."""
        return self.links.read().where("kind = 'stranger'").select(F.col("u").alias("title"), "people").distinct()

    def vertices(self, features: DataFrame, strangers: DataFrame | None = None) -> DataFrame:
        """(id, vertex) of rows that were appended.  strangers: those of the index, if they are kept apart from it."""
        return _placed(features, self.strangers() if strangers is None else strangers).select("id", "vertex")

    def works(self) -> DataFrame:
        """(vertex, work) of the vertices that something ties to another; any other is a work of its own.

        Only what came since the last call is contracted, between the works that it touches.
        """
        fresh = F.col("n") > self.done
        links = self.links.read()
        near = links.where("kind = 'near'").select("u", "v", "n")
        pairs = near.where(fresh)
        if self.done:  # new people may vouch for titles that were near before
            changed = self.titles.read().where(fresh).select("title").distinct()
            pairs = pairs.unionByName(near.join(changed.withColumnRenamed("title", "u"), "u", "left_semi")).unionByName(near.join(changed.withColumnRenamed("title", "v"), "v", "left_semi").select(*near.columns))
        pairs = self.scratch.save(pairs.select("u", "v").distinct(), "pairs")
        asked = pairs.select(F.explode(F.array("u", "v")).alias("title")).distinct()
        people = self.titles.read().select("title", F.array_join("words", " ").alias("w")).join(asked.hint("shuffle_hash"), "title", "left_semi")
        people = people.groupBy("title").agg(F.trim(F.array_join(F.array_sort(F.collect_set("w")), " ")).alias("people"))
        side = lambda n: people.select(F.col("title").alias(n), F.col("people").alias(f"people_{n}"))
        tied = links.where(fresh & (F.col("kind") == "sure")).select("u", "v").unionByName(of_same_people(pairs.join(side("u"), "u").join(side("v"), "v")))
        old = self.known_works
        if old is not None:
            at = lambda end: old.select(F.col("vertex").alias(end), F.col("work").alias(f"w{end}"))
            tied = tied.join(at("u"), "u", "left").join(at("v"), "v", "left").select(F.coalesce("wu", "u").alias("u"), F.coalesce("wv", "v").alias("v"))
        moved = connected_components(self.spark, self.scratch.save(tied, "tied"))
        if old is not None:
            kept = old.join(moved.select(F.col("vertex").alias("work"), F.col("component").alias("to")), "work", "left").select("vertex", F.coalesce("to", "work").alias("work"))
            moved = self.scratch.save(kept.unionByName(moved.select("vertex", F.col("component").alias("work")).join(old.select("vertex"), "vertex", "left_anti")), "works")
        else:
            moved = moved.withColumnRenamed("component", "work")
        self.known_works, self.done = moved, self.n
        return moved

    def drop(self) -> None:
        """Delete the index."""
        for t in (self.titles, self.blocks, self.links):
            t.drop()


def paper_rows(papers: DataFrame) -> DataFrame:
    """papers as rows of the index, by paper_id.  Repeated rows count once, as they give the same features."""
    return papers.where(F.col("paper_id").isNotNull()).select(F.col("paper_id").alias("id"), "title", "authors", "doi", "arxiv_id")


def raw_rows(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("raw_id").isNotNull()).select(F.col("raw_id").alias("id"), "title", "authors", "doi", "arxiv_id", "batch_id")


def bucket_count(papers: DataFrame, raw: DataFrame) -> int:
    return max(4, (papers.count() + raw.count()) // BUCKET_ROWS)


def known_works(spark: SparkSession, raw: DataFrame, papers: DataFrame, deliveries: list[list[int | None]] | None = None) -> DataFrame:
    """(raw_id, known_as) of every raw row whose work is in papers or in a raw row of smaller raw_id.

    known_as is the smallest paper_id of the work, else ``raw:`` and its smallest raw_id.  Papers are the first delivery to the
    index, then each batch_id in order (``deliveries`` groups them otherwise, None standing for rows without one, which
    come last).  Null titles are known by their identifiers only; a row with neither is a work of its own.
    """
    index = FingerprintIndex(spark, buckets=bucket_count(papers, raw))
    features = index.scratch.save(work_features(raw_rows(raw), ("batch_id",)), "raw", by="batch_id")
    accepted = index.scratch.save(work_features(paper_rows(papers)), "papers")
    if deliveries is None:  # one row a delivery
        deliveries = [[r["batch_id"]] for r in features.select("batch_id").distinct().orderBy(F.asc_nulls_last("batch_id")).collect()]
    index.append(accepted)
    for batches in deliveries:
        numbered = [b for b in batches if b is not None]
        index.append(features.where(F.col("batch_id").isin(numbered) | (F.col("batch_id").isNull() if None in batches else F.lit(False))))
        trim_driver(spark)
    strangers = index.scratch.save(index.strangers(), "strangers")
    rows, known = index.vertices(features, strangers), index.vertices(accepted, strangers).select(F.col("id").alias("paper"), "vertex")
    # The least ids of each vertex, then of each work: partial minima before every shuffle.
    firsts = known.groupBy("vertex").agg(F.min("paper").alias("paper")).select("vertex", "paper", F.lit(None).cast("long").alias("raw"))
    firsts = firsts.unionByName(rows.groupBy("vertex").agg(F.min("id").alias("raw")).select("vertex", F.lit(None).cast("string").alias("paper"), "raw"))
    placed = firsts.join(index.works(), "vertex", "left").select("vertex", F.coalesce("work", "vertex").alias("work"), "paper", "raw")
    placed = index.scratch.save(placed, "vertices")
    # The result reads no more than these: the index would stay in the session's catalog and on disk.
    index.drop()
    index.scratch.close(features, strangers, placed)
    first = placed.groupBy("work").agg(F.min("paper").alias("paper"), F.min("raw").alias("first"))
    by_vertex = placed.where(F.col("raw").isNotNull()).select("vertex", "work").join(first, "work").select("vertex", "paper", "first")
    tied = rows.join(by_vertex, "vertex").where(F.col("paper").isNotNull() | (F.col("id") > F.col("first")))
    return tied.select(F.col("id").alias("raw_id"), F.coalesce("paper", F.concat(F.lit("raw:"), F.col("first").cast("string"))).alias("known_as"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known_works(spark, table(spark, sf_dir, "raw_papers"), table(spark, sf_dir, "papers"))
