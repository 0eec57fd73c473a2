"""Text matching and normalising as Column expressions (built-ins only, so whole-stage code is generated)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyral.functions import wordlists as L

# Fixed values below, where patterns name words or shapes: surveys, acronyms, repository addresses.
WORD = r"[\p{L}\p{N}_]"
_SPLIT = r"[^\p{L}\p{N}_]+"


# White space of any script, as one class that every regular-expression engine here reads alike.
WHITE = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]+"


def normalize_ws(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, WHITE, " "))


def strip_tags(c: Column) -> Column:
    """Tags become spaces; nothing left gives null."""
    return F.nullif(normalize_ws(F.regexp_replace(c, r"<[^>]+>", " ")), F.lit(""))


def pattern(term: str) -> str:
    """A pattern for a term at word borders.  A border next to a non-word character needs a word character there."""
    t = term.lower()
    word = lambda ch: bool(re.match(r"\w", ch))
    left = rf"(?<!{WORD})" if word(t[0]) else rf"(?<={WORD})"
    right = rf"(?!{WORD})" if word(t[-1]) else rf"(?={WORD})"
    return left + re.sub(r"([.\\+*?()\[\]{}|^$])", r"\\\1", t) + right


def first_word(term: str) -> str:
    """The first word of a term that begins with one, else ''."""
    m = re.match(r"\w+", term.lower())
    return m[0] if m else ""


def term_hits(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """docs' columns but ``text``, and ``term`` for every term that stands in the text at word borders, in any case.

    Documents are met with terms by the terms' first words: only words that begin some term leave the
    document's word set, so the pattern runs on likely pairs and no documents-times-terms join exists.  terms is
    a parameter of at most a few thousand strings; it travels in the plan.
    """
    spark = docs.sparkSession
    rows = [(t, first_word(t), pattern(t)) for t in dict.fromkeys(terms) if t]
    if not rows:
        return docs.drop(text).withColumn("term", F.lit(None).cast("string")).limit(0)
    lookup = spark.createDataFrame(rows, "term string, __first string, __pattern string")
    firsts = F.array(*[F.lit(w) for w in sorted({r[1] for r in rows})])
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    words = F.array_append(F.split(low, _SPLIT), F.lit(""))
    met = docs.withColumn("__low", low).withColumn("__first", F.explode(F.array_intersect(firsts, words)))
    return met.join(F.broadcast(lookup), "__first").where(F.rlike(F.col("__low"), F.col("__pattern"))).drop("__low", "__first", "__pattern", text)


def looks_like_survey(title: Column, abstract: Column) -> Column:
    rule = r"(?i)(?<![\p{L}\p{N}_])(survey|review|overview|comprehensive)(?![\p{L}\p{N}_])"
    return F.coalesce(title, F.lit("")).rlike(rule) | F.substring(F.coalesce(abstract, F.lit("")), 1, 200).rlike(rule)


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(normalize_ws(F.coalesce(c, F.lit("")))), " "), lambda w: w != "")


def looks_like_english(c: Column) -> Column:
    """Fewer than 12 words, or at least 8 percent of them among the markers."""
    words = _words(c)
    share = F.size(F.filter(words, lambda w: w.isin(*L.ENGLISH_MARKERS))) / F.size(words)
    return (F.size(words) < 12) | (share >= 0.08)


def bigrams(c: Column) -> Column:
    """Distinct phrases of two neighbouring words (letters only, or with a hyphen), boilerplate left out; empty for other languages."""
    kept = F.filter(_words(c), lambda w: w.rlike(r"^\p{L}+$") | w.contains("-"))
    barred = (*L.STOPWORDS, *L.REPORTING_WORDS)
    pairs = F.zip_with(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    good = F.filter(pairs, lambda p: ~p["a"].isin(*barred) & ~p["b"].isin(*barred))
    grams = F.array_distinct(F.transform(good, lambda p: F.concat_ws(" ", p["a"], p["b"])))
    long = F.filter(F.array_except(grams, F.array(*[F.lit(x) for x in L.STOP_BIGRAMS])), lambda g: F.length(g) >= 8)
    return F.when(looks_like_english(c), long).otherwise(F.array().cast("array<string>"))


def acronyms(c: Column) -> Column:
    """Distinct lower-cased words shaped like acronyms or coinages (ALLCAPS, CamelCase), the common ones left out."""
    words = F.split(F.coalesce(c, F.lit("")), _SPLIT)
    shaped = F.filter(words, lambda w: w.rlike(r"^(?:[A-Z]{2,6}|[A-Z][a-z]+[A-Z][A-Za-z0-9]*)$"))
    low = F.array_distinct(F.transform(shaped, lambda w: F.lower(w)))
    return F.filter(F.array_except(low, F.array(*[F.lit(x) for x in L.STOP_ACRONYMS])), lambda w: F.length(w) >= 3)


def significant_words(c: Column) -> Column:
    """Up to five distinct words of a phrase, in order: at least three characters, no search stop words."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s-]", " "), r"\s+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*L.SEARCH_STOPWORDS))), 1, 5)


def github_url(c: Column) -> Column:
    """The first repository address in a text; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?i)(https?://github\.com/[\w.\-]+/[\w.\-]+)", 1), F.lit(""))


def quoted_phrases(c: Column) -> Column:
    """Sorted distinct phrases in straight double quotes, trimmed, of four characters at least."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r'"([^"]+)"'), F.lit(1)), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(x) >= 4)))


def _folding() -> tuple[str, str, list[tuple[str, str]]]:
    """(letters, their ASCII letters, [(letter, its ASCII letters)]): what compatibility decomposition leaves in ASCII of every
    character of the basic plane, by the Unicode tables; those that leave one character, and letters that leave more."""
    one, plain, more = [], [], []
    for code in range(0x80, 0x10000):
        c = chr(code)
        left = "".join(x for x in unicodedata.normalize("NFKD", c) if x < "\x80")
        if len(left) == 1:
            one.append(c)
            plain.append(left)
        elif left and unicodedata.category(c).startswith("L"):
            more.append((c, left))
    return "".join(one), "".join(plain), more


_ONE, _PLAIN, _MORE = _folding()
_FIRST_OF_MORE = "[" + "".join(c for c, _ in _MORE) + "]"


def strip_accents(c: Column) -> Column:
    """ASCII letters of a text: letters of any alphabet lose their marks as Unicode takes them apart, any other character is dropped."""
    wide = c
    for letter, left in _MORE:
        wide = F.replace(wide, F.lit(letter), F.lit(left))
    c = F.when(c.rlike(_FIRST_OF_MORE), wide).otherwise(c)
    return F.regexp_replace(F.translate(c, _ONE, _PLAIN), r"[^\x00-\x7F]", "")


def normalized_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"[^a-z0-9]+", " "))


def surname(name: Column) -> Column:
    """The part before a comma, else the last word, in plain letters; '' where nothing is left."""
    clean = F.lower(strip_accents(normalize_ws(name)))
    part = F.when(clean.contains(","), F.split(clean, ",")[0]).otherwise(F.element_at(F.split(clean, " "), -1))
    return F.regexp_replace(part, "[^a-z]", "")


def canonical_key(doi: Column, arxiv_id: Column, title: Column, authors: Column, year: Column) -> Column:
    """``doi:``, else ``arxiv:`` without version, else ``hash:`` of title, first surname and year."""
    d = F.nullif(F.regexp_replace(F.lower(F.trim(doi)), r"^https?://doi\.org/", ""), F.lit(""))
    a = F.nullif(F.regexp_replace(F.lower(F.trim(arxiv_id)), r"v\d+$", ""), F.lit(""))
    first = F.coalesce(surname(F.try_element_at(authors, F.lit(1))), F.lit(""))
    seed = F.concat_ws("|", F.coalesce(normalized_title(title), F.lit("")), first, F.coalesce(year.cast("string"), F.lit("")))
    return F.coalesce(F.concat(F.lit("doi:"), d), F.concat(F.lit("arxiv:"), a), F.concat(F.lit("hash:"), F.substring(F.sha1(seed), 1, 16)))


DOMAIN_TOO_GENERAL = ("vision-language",)


def domain_markers(queries: Column) -> Column:
    """The phrases of an array of niche queries by which a paper belongs to the domain: quoted ones, the too general left out."""
    phrases = F.array_sort(F.array_distinct(F.flatten(F.transform(queries, quoted_phrases))))
    return F.array_except(phrases, F.array(*[F.lit(x) for x in DOMAIN_TOO_GENERAL]))


def matches_any(text: Column, phrases: list[str]) -> Column:
    """Whether any phrase stands in the text at word borders, in any case."""
    if not phrases:
        return F.lit(False)
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(f"(?:{pattern(p)})" for p in phrases))


def archive_query(phrase: Column) -> Column:
    """The query of a saved search: the exact phrase in the abstract, or all of its significant words if there are two or more."""
    trimmed = F.regexp_replace(phrase, f"^{WHITE}|{WHITE}$", "")
    words = significant_words(trimmed)
    exact = F.concat(F.lit('abs:"'), F.replace(trimmed, F.lit('"'), F.lit("")), F.lit('"'))
    every = F.array_join(F.transform(words, lambda w: F.concat(F.lit("abs:"), w)), " AND ")
    return F.when(F.size(words) < 2, exact).otherwise(F.concat(exact, F.lit(" OR ("), every, F.lit(")")))


def shortened(c: Column, n: int) -> Column:
    """The first ``n`` characters, with an ellipsis if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def keyword_hit(text: Column, words: list[str]) -> Column:
    """Whether any keyword is in the text, in any case; no keywords hit everything."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(not words)
    for w in words:
        hit = hit | low.contains(w.lower())
    return hit
