"""Reading level of each document: classic grade formulas and the median of their estimates.

Three formulas (Coleman-Liau, Flesch reading ease, FORCAST) are computed from sentence length,
syllables (hyphenation-style rules) and letters.  As their scales differ, each estimate is
read as a level from 1 to 5 by four cuts of its own, fitted to readers' labels (at most
:data:`MAX_LABELS` labelled documents); the band is the median of the estimates.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyral.session import table

#: At most so many labelled documents are used for the four cuts.
MAX_LABELS = 20000
MIN_WORDS = 40
#: The formulas, each rising with difficulty, and their cuts where there are no labels to fit them to.
DEFAULT_CUTS = {"coleman_liau": (5.0, 10.5, 17.5, 24.0), "flesch": (-95.0, -62.0, -15.0, 32.0), "forcast": (7.0, 9.75, 12.0, 12.75)}

# Function words by which English is told from other languages.
ENGLISH = frozenset(
    "the a an of and to in is are was were be been for on with by at from that this these those it its as or not but can could may might "
    "will would must should do does did has have had we our you your they their he she his her each one which who when while because if "
    "than then so such some any no more most other into over under between near also both all there where what how why i my me".split()
)
SENTENCE_END = re.compile(r"[.!?。!?]+(?=[\s\"'”’)\]<]|$)")
TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<[|/][^<>]{0,60}>")
WORD = re.compile(r"[^\W\d_]+(?:['’\-‐][^\W\d_]+)*")
BLOCK = re.compile(r"(?:\r\n|\r|\n| )[\s]*(?=(?:[#>*\-•]|\d+[.)])\s)|\n\s*\n")
VOWELS = re.compile(r"[aeiouy]+")
# Two vowels that are two syllables, and endings whose e is silent.
HIATUS = re.compile(r"i[ao](?!n$|ns$|us|nal|u)|eo(?!u)|ua(?!r)|ue(?=t|l)|uo|(?<=[^aeiou])ying|ism$|iu[mv]|(?<!t)(?<!s)(?<!c)(?<!g)io(?=n$)")
SILENT = re.compile(r"(?:[^aeiouylr]|[aeiouy][lr])e$|[^aeiouytd]ed$|[^aeiouyscxzg]es$|(?<=[a-z])(?<=[^aeiou])ely$|ement(?:s)?$")


@lru_cache(maxsize=200_000)
def syllables(word: str) -> int:
    """Syllables of a lower-case word, 1 at least; parts of a hyphened word are counted apart."""
    if "-" in word:
        return sum(syllables(p) for p in word.split("-") if p)
    n = len(VOWELS.findall(word)) + len(HIATUS.findall(word)) - len(SILENT.findall(word))
    return max(1, n)


def clean_text(text: str) -> str:
    text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return text.replace("‐", "-").replace("​", "").replace("\xad", "")


def measures(text: str | None) -> tuple[int, float, float, float, float] | None:
    """(words, share of English function words, one estimate a formula of DEFAULT_CUTS); None without a word."""
    if not text:
        return None
    text = BLOCK.sub(" . ", clean_text(text))
    words = WORD.findall(text)
    if not words:
        return None
    n = len(words)
    low = [w.lower() for w in words]
    english = sum(w in ENGLISH for w in low) / n
    sentences = max(1, sum(1 for s in SENTENCE_END.split(text) if WORD.search(s)))
    per_word = [syllables(w) for w in low]
    letters = sum(map(len, words))
    return (
        n,
        english,
        5.88 * letters / n - 29.6 * sentences / n - 15.8,
        -(206.835 - 1.015 * n / sentences - 84.6 * sum(per_word) / n),
        20 - 15 * per_word.count(1) / n,
    )


def grades(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, english, coleman_liau, flesch, forcast) of every document; wordless texts have 0 words and null estimates."""
    columns = documents.select(key, F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures(t) or (0, 0.0, None, None, None) for t in batch.column(1).to_pylist()]
            n, *estimates = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(e, pa.float64()) for e in estimates)], names=[key, "n_words", "english", *DEFAULT_CUTS])

    return columns.mapInArrow(run, f"`{key}` {columns.schema[key].dataType.simpleString()}, n_words bigint, english double, " + ", ".join(f"{c} double" for c in DEFAULT_CUTS))


def fit_cuts(labelled: list[tuple[float, float]], default: tuple[float, ...]) -> tuple[float, ...]:
    """The four cuts that err least on (estimate, label), each by its own: labels up to b below it, the others above.

    Cuts never fall; a cut that no label speaks for is the default.
    """
    if not labelled:
        return default
    g, y = (np.array(x, float) for x in zip(*sorted(labelled)))
    cuts = []
    for b in range(1, 5):
        low = (y <= b + 0.25).astype(float)
        if low.all() or not low.any():
            cuts.append(default[b - 1])
            continue
        # Errors if the first i are called low; the middle of the best stretch.
        err = np.concatenate([[0], np.cumsum(1 - low)]) + np.concatenate([np.cumsum(low[::-1])[::-1], [0]])
        best = np.flatnonzero(err == err.min())
        i = int(best[len(best) // 2])
        cuts.append(float(g[0] - 1 if i == 0 else g[-1] + 1 if i == len(g) else (g[i - 1] + g[i]) / 2))
    return tuple(float(c) for c in np.maximum.accumulate(cuts))


ENGLISH_SHARE = 0.2


def reading_bands(documents: DataFrame, labels: DataFrame, scratch=None) -> DataFrame:
    """(doc_id, band): band 1 (easiest) to 5 of every document with an English text of at least 40 words.

    The text decides whether it is English, not the language column.  Labels: the median of a document's readers, null
    bands left out; without labels the default cuts hold.
    """
    graded = grades(documents)
    if scratch is not None:
        graded = scratch.save(graded, "grades")
    graded = graded.where((F.col("n_words") >= MIN_WORDS) & (F.col("english") >= ENGLISH_SHARE))
    # The sample is drawn from the labelled ids before anything is joined, so what is sent about is bounded by MAX_LABELS.
    bands = labels.where(F.col("band").isNotNull() & F.col("doc_id").isNotNull())
    chosen = bands.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELS)
    middle = bands.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.percentile("band", 0.5).alias("label"))
    sample = graded.join(F.broadcast(middle), "doc_id").select(*DEFAULT_CUTS, "label").collect()
    levels = []
    for name, default in DEFAULT_CUTS.items():
        cuts = fit_cuts([(r[name], r["label"]) for r in sample], default)
        levels.append(sum(((F.col(name) > F.lit(c)).cast("int") for c in cuts), F.lit(1)))
    return graded.select("doc_id", F.element_at(F.array_sort(F.array(*levels)), 2).cast("int").alias("band"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyral.session import Scratch

    return reading_bands(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"), Scratch(spark, "reading"))
