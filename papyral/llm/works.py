"""What tells one work from another: normalised titles, author tokens, fingerprints, and the text check.

Used by the operators that match records of works typed differently from feed to feed.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyral.functions.identifiers import clean_arxiv, clean_doi

# Letters that Unicode does not take apart into a base letter and a mark.
SINGLE = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i", "þ": "th", "ð": "d"})
# Short forms in titles and what they stand for.
SHORT_FORMS = {
    "wm": "world model",
    "us": "ultrasound",
    "vit": "transformer",
    "nn": "neural",
    "ct": "tomography",
    "ssl": "self supervised",
    "ecg": "electrocardiogram",
    "ecgs": "electrocardiograms",
    "eeg": "electroencephalogram",
    "eegs": "electroencephalograms",
    "mri": "magnetic resonance",
    "rl": "reinforcement learning",
    "llm": "language model",
    "llms": "language models",
    "dl": "deep learning",
    "ml": "machine learning",
}
# Words that feeds add, drop or exchange in titles.
LIGHT = frozenset("the a an and for in of on with w from to at by".split())
NUMERALS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
# Words by which a work is another than the one its title resembles.
OTHER_WORK = {"erratum": "erratum", "errata": "erratum", "corrigendum": "erratum", "correction": "erratum", "addendum": "addendum", "replication": "replication", "reply": "reply", "response": "reply", "rejoinder": "reply", "comment": "comment", "comments": "comment", "revisited": "revisited", "followup": "followup", "supplement": "supplement", "retraction": "retraction"}
# Words that, added at the end of a title, name another study rather than a title cut short.
QUALIFIERS = frozenset("children adults infants women men adolescents neonates elderly".split())
ORGANISATION = frozenset("laboratory lab labs institute centre center consortium collaboration collab working group university hospital team network department clinic school college imaging learning robotics cardiology neuroscience screening".split())

PREFIX = re.compile(r"^[^\w(\[]*(?:[\(\[]\s*(?:v\d+|preprint|version \d+|draft)\s*[\)\]]|retitled\b|preprint\s*:)[\s:.\-–—‐]*")
TEX = re.compile(r"\\[a-zA-Z]+\{([^{}]*)\}")
TAG = re.compile(r"</?[A-Za-z][^<>]{0,40}>")
SPLIT = re.compile(r"[^\w+]+")
PART = re.compile(r"\bpart (\w+)")
FOLLOW = re.compile(r"\bfollow[\s\-‐‑–]+up\b")
LETTERS = re.compile(r"[a-z]{3,}")
CUT = re.compile(r"(?:…|\.\.\.|\[\.\.\.\])\W*$")
YEAR_SPELLING = re.compile(r"is(ation|ations|e|ed|es|ing|er)$")
#: Titles of fewer tokens are tied to their authors too.
SHORT_TITLE = 4
BLOCKS, BITS = 4, 16
#: The rotated tables: the blocks in front, and whether an author's word is part of the key.  Any two changed blocks leave
#: a pair, any one changed block a triple; the last table is that of short titles.
TABLES = (*(([i, j], True) for i in range(BLOCKS) for j in range(i + 1, BLOCKS)), *(([i for i in range(BLOCKS) if i != k], False) for k in range(BLOCKS)), ([0, 1, 2, 3], True))
NAMED = sum(1 << k for k, (_, named) in enumerate(TABLES) if named)
#: Bits in which the fingerprints of one work's titles may differ.  Two titles that share two blocks by chance differ in 16 on average.
MAX_BITS = 14
#: For each letter, the counts (from, to) at which a title sets a bit: 64 bits, near the middle of what titles of papers hold.
COUNTED = {"a": (4, 6), "b": (1, 2), "c": (2, 4), "d": (1, 3), "e": (4, 8), "f": (1, 2), "g": (1, 3), "h": (1, 2), "i": (4, 7), "k": (1, 1), "l": (2, 4), "m": (1, 3), "n": (3, 6), "o": (3, 6), "p": (1, 3), "r": (3, 6), "s": (3, 6), "t": (3, 6), "u": (1, 3), "v": (1, 1), "w": (1, 1), "y": (1, 1), "z": (1, 1)}
#: Letters that the whole one of two titles may have more than the other: one a slip.
MAX_LETTERS = 2


def fold(text: str) -> str:
    """Lower case, without accents."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.translate(SINGLE))
    return "".join(c for c in text if not unicodedata.combining(c)).casefold()


@lru_cache(maxsize=200_000)
def _spelled(w: str) -> str:
    return YEAR_SPELLING.sub(r"iz\1", w) if len(w) > 6 else w


def title_tokens(title: str | None) -> list[str]:
    """The tokens of a title in order, free of markup, prefixes, light words and spelling habits.

    The number of an instalment becomes one token ``#2``; reply, erratum and the like ``#reply``.
    """
    if not title:
        return []
    t = title
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = TAG.sub("", t)
    if "\\" in t:
        t = TEX.sub(r"\1", t)
    t = fold(t.replace("$", ""))
    while m := PREFIX.match(t):
        t = t[m.end() :]
    if "follow" in t:
        t = FOLLOW.sub("followup", t)
    words = [w for w in SPLIT.split(t) if w]
    out: list[str] = []
    for i, w in enumerate(words):
        if w in LIGHT:
            continue
        if w in OTHER_WORK:
            out.append("#" + OTHER_WORK[w])
        elif w == "part" and i + 1 < len(words):
            continue
        elif i and words[i - 1] == "part":
            n = NUMERALS.get(w) or (int(w) if w.isdigit() and len(w) < 4 else None)
            out += [f"#{n}"] if n else ["part", w]
        elif len(w) > 1 and w in NUMERALS and i >= len(words) - 2 and w not in ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"):
            out.append(f"#{NUMERALS[w]}")
        else:
            out += SHORT_FORMS.get(w, w).split()
    if "#reply" in out:
        out = [w for w in out if w != "#comment"]
    return [_spelled(w) for w in out]


def author_tokens(authors: list[str] | None) -> list[str]:
    """Sorted distinct words of three letters and more of all names; general words of organisations left out."""
    return sorted(set(LETTERS.findall("\n".join(map(fold, filter(None, authors or ()))))) - ORGANISATION)


def _h(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


@lru_cache(maxsize=50_000)
def _gram(g: str) -> tuple[int, int]:
    """(order, votes): a hash by which grams compete for the block, and 16 counters of 16 bits with 0 or 1 in each."""
    h = _h(g)
    return h >> 24, sum(((h >> b) & 1) << (16 * b) for b in range(BITS))


@lru_cache(maxsize=200_000)
def _token(t: str) -> tuple[int, int, int]:
    """(block, votes, grams) of a word: its block is that of its least pair of letters, so a slip mostly leaves it there."""
    padded = f"^{t}$"
    grams = [_gram(g) for g in {padded[i : i + 2] for i in range(len(padded) - 1)}]
    return min(g[0] for g in grams) % BLOCKS, sum(g[1] for g in grams), len(grams)


def fingerprints(titles: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(print, tables) of token lists.

    print: 64 bits, four blocks of 16.  Each distinct word belongs to one block; the pairs of letters of a block's words
    vote on each of its bits, the majority sets it.  So a mistyped word changes few bits, mostly of one block, and
    order changes none.  tables: a bit for each of TABLES in which the record is stored, which is where the
    blocks in front hold words enough to say something (an empty block never is a key).  Short titles, of whose words
    any is too much to differ, have the hash of all words as their print and the last table only.
    """
    lanes, counts, exact = bytearray(), [], np.zeros(len(titles), np.int64)
    for i, tokens in enumerate(titles):
        words = set(tokens)
        votes, grams, n = [0] * BLOCKS, [0] * BLOCKS, [0] * BLOCKS
        for t in words:
            b, v, g = _token(t)
            votes[b] += v
            grams[b] += g
            n[b] += 1
        for v in votes:
            lanes += v.to_bytes(2 * BITS, "little")
        counts.append((*grams, *n))
        if len(tokens) < SHORT_TITLE:
            exact[i] = _signed(_h(" ".join(sorted(tokens))))
    if not titles:
        return exact, np.zeros(0, np.int32)
    ballots = np.frombuffer(bytes(lanes), "<u2").reshape(len(titles), BLOCKS, BITS).astype(np.int32)
    made = np.array(counts, np.int32)
    grams, n = made[:, :BLOCKS], made[:, BLOCKS:]
    bits = (2 * ballots > grams[:, :, None]).reshape(len(titles), BLOCKS * BITS)
    prints = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
    short = np.array([len(t) < SHORT_TITLE for t in titles])
    some = np.array([len(t) > 0 for t in titles])
    words = n.sum(axis=1)
    tables = np.zeros(len(titles), np.int32)
    for k, (blocks, named) in enumerate(TABLES[:-1]):
        least = np.where(words >= 6, 2, 1) if named else 2
        tables |= np.where(n[:, blocks].sum(axis=1) >= least, 1 << k, 0).astype(np.int32)
    tables = np.where(short, np.where(some, 1 << (len(TABLES) - 1), 0), tables)
    return np.where(short, exact, prints), tables.astype(np.int32)


def near(a: str, b: str) -> bool:
    """At most one letter added, dropped, exchanged or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    m = min(len(a), len(b))
    while i < m and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


LIGHT_LONG = tuple(w for w in LIGHT if len(w) >= 3)
# They with two neighbouring letters swapped.
LIGHT_SWAPPED = tuple(w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in LIGHT_LONG for i in range(len(w) - 1))


@lru_cache(maxsize=200_000)
def _letters(t: str) -> int:
    """A counter of 8 bits for each letter of COUNTED; nothing is counted of light words and slips of them, which titles may lack."""
    return 0 if any(near(t, w) for w in LIGHT_LONG) else sum(min(t.count(c), 255) << 8 * k for k, c in enumerate(COUNTED))


def letter_bits(titles: list[list[str]]) -> np.ndarray:
    """64 bits of token lists, one for each count of COUNTED that a title reaches (see :func:`like_letters`).

    None for a title that repeats a word, or is so long that a counter might run over.
    """
    held = bytearray()
    for tokens in titles:
        told = len(set(tokens)) == len(tokens) and sum(map(len, tokens)) < 256
        held += (sum(map(_letters, tokens)) if told else 0).to_bytes(len(COUNTED), "little")
    have = np.frombuffer(bytes(held), np.uint8).reshape(len(titles), len(COUNTED))
    reached = [have[:, k] >= least for k, (low, high) in enumerate(COUNTED.values()) for least in range(low, high + 1)]
    return np.packbits(np.stack(reached, axis=1), axis=1, bitorder="little").view("<i8").ravel()


def same_title(x: list[str], y: list[str]) -> bool:
    """The same title but for order, two mistyped words and up to two words cut off at the end.

    A slip may also move or drop the border of two words.  Instalment numbers and words such as erratum must agree.
    """
    if len(x) < SHORT_TITLE or len(y) < SHORT_TITLE or abs(len(x) - len(y)) > 3:
        return False
    cx, cy = Counter(x), Counter(y)
    only_x, only_y = cx - cy, cy - cx
    if any(w[0] == "#" for w in only_x) or any(w[0] == "#" for w in only_y):
        return False
    left_x = [w for w in x if w in only_x and not any(near(w, v) for v in LIGHT_LONG)]
    left_y = [w for w in y if w in only_y and not any(near(w, v) for v in LIGHT_LONG)]
    slips = 0
    for w in list(left_x):
        partner = next((v for v in left_y if len(w) >= 3 and len(v) >= 3 and near(w, v)), None)
        if partner:
            left_x.remove(w)
            left_y.remove(partner)
            slips += 1
    if left_x and left_y and max(len(left_x), len(left_y)) <= 3:
        for n in range(3):  # the border of two words, and up to two words cut off behind it
            for u, v in ((left_x, "".join(left_y[: len(left_y) - n])), (left_y, "".join(left_x[: len(left_x) - n]))):
                if len(v) >= 5 and near("".join(u), v):
                    rest = left_y[len(left_y) - n :] if u is left_x else left_x[len(left_x) - n :]
                    left_x, left_y = ([], rest) if u is left_x else (rest, [])
                    slips += 1
                    break
            if not (left_x and left_y):
                break
    if slips > 2 or (left_x and left_y):
        return False
    missing, whole = (left_y, y) if left_y else (left_x, x)
    if len(missing) > 2:
        return False
    # What is missing was cut off: it stands at the end of the longer title, an instalment's number aside.
    tail = [w for w in whole if w[0] != "#"][-(len(missing) + 1) :]
    return all(w in tail for w in missing) and not any(w in QUALIFIERS for w in missing)


def same_people(x: list[str], y: list[str]) -> bool:
    """No authors known on one side, or a name word in common, one letter aside."""
    if not x or not y or not set(x).isdisjoint(y):
        return True
    return any(near(a, b) for a in x if len(a) >= 5 for b in y if len(b) >= 5)


FEATURES = "title bigint, tokens string, people string, print bigint, tables int, letters bigint"


def work_features(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, doi, arxiv, *keep, title, tokens, people, print, tables, letters) of rows with id, title, authors, doi, arxiv_id.

    title is a 64-bit hash of the sorted tokens, with an author token if the title is short; null for a title without
    tokens (null, empty, only signs).  tokens and people are space-separated.
    """
    columns = rows.select("id", clean_doi(F.col("doi")).alias("doi"), clean_arxiv(F.col("arxiv_id")).alias("arxiv"), *keep, "title", "authors")
    n = 3 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, people = [], []
            lists = []
            for title, names in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()):
                t, p = title_tokens(title), author_tokens(names)
                short = len(t) < SHORT_TITLE
                titles.append(_signed(_h(" ".join(sorted(t)) + ("\x1d" + min(p, key=_h, default="") if short else ""))) if t else None)
                lists.append(t)
                people.append(" ".join(p))
            prints, tables = fingerprints(lists)
            own = [batch.column(i) for i in range(n)]
            made = [pa.array(titles, pa.int64()), pa.array([" ".join(t) for t in lists], pa.string()), pa.array(people, pa.string()), pa.array(prints, pa.int64()), pa.array(tables, pa.int32()), pa.array(letter_bits(lists), pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *made], names=["id", "doi", "arxiv", *keep, "title", "tokens", "people", "print", "tables", "letters"])

    kept = "".join(f"{c} {columns.schema[c].dataType.simpleString()}, " for c in keep)
    return columns.mapInArrow(run, f"id {columns.schema['id'].dataType.simpleString()}, doi string, arxiv string, {kept}{FEATURES}")


def block_keys(df: DataFrame, words: Column, *keep: str) -> DataFrame:
    """(*keep, t, key) of df's rows (print, tables): a row for each table that holds the record, and for each of ``words`` (an
    array of author words) where the table's key has one.  The key is a hash of the blocks in front and the word."""
    front = lambda blocks: _signed(sum(0xFFFF << (BITS * b) for b in blocks))
    rotated = F.array(*[F.struct(F.lit(k).alias("t"), F.lit(1 << k).alias("bit"), F.lit(front(blocks)).alias("mask"), F.lit(named).alias("named")) for k, (blocks, named) in enumerate(TABLES)])
    stored = df.select(*keep, "print", "tables", words.alias("__w"), F.inline(rotated)).where(F.col("tables").bitwiseAND(F.col("bit")) != 0)
    spread = stored.select(*keep, "t", F.col("print").bitwiseAND(F.col("mask")).alias("__f"), F.explode(F.when(F.col("named"), F.col("__w")).otherwise(F.array(F.lit("")))).alias("__a"))
    return spread.select(*keep, "t", F.xxhash64("t", "__f", "__a").alias("key"))


def alike(u: str, v: str) -> Column:
    """Whether two fingerprints differ in MAX_BITS at most."""
    return F.bit_count(F.col(u).bitwiseXOR(F.col(v))) <= MAX_BITS


def like_letters(u: str, v: str) -> Column:
    """False only where the letters of two titles show that they can't pass :func:`same_title`.

    Of two titles that pass, one has nothing that the other lacks but for two slips, each of which brings one letter at most; a
    moved border brings none.  The bits that one has and the other has not are no more than the letters that it has
    more.  Titles without bits pass.
    """
    more = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b)))) <= MAX_LETTERS
    return more(u, v) | more(v, u)


def worth_checking(u: Column, v: Column) -> Column:
    """False only where two token strings can't pass :func:`same_title`, told by built-in functions.

    Of the words that only one has, slips of light words aside, one side must have none, or some pair be within two
    edits and one side have fewer than five, or one side's joined be within two edits of the other's, of which up to two
    are left off at the end.  Titles that repeat a word are always worth it.
    """
    a, b = F.split(u, " "), F.split(v, " ")
    heavy = lambda w: ~(F.exists(F.array(*[F.lit(z) for z in LIGHT_LONG]), lambda z: F.levenshtein(w, z, 1) >= 0) | w.isin(*LIGHT_SWAPPED))
    alike = lambda p, q: F.levenshtein(p, q, 2) >= 0

    def passes(x: Column, y: Column) -> Column:
        n, m = F.size(x), F.size(y)
        close = (F.least(n, m) < 5) & F.exists(x, lambda p: F.exists(y, lambda q: alike(p, q)))
        cut = lambda w, k: F.array_join(F.slice(w, 1, F.greatest(F.size(w) - k, F.lit(0))), "")
        joined = [alike(cut(x, i), cut(y, j)) for i, j in ((0, 0), (0, 1), (0, 2), (1, 0), (2, 0))]
        return (n == 0) | (m == 0) | close | ((F.greatest(n, m) <= 3) & reduce(Column.__or__, joined))

    # A list of one struct, so that the two lists of words are made once.
    own = F.array(F.struct(F.filter(F.array_except(a, b), heavy).alias("x"), F.filter(F.array_except(b, a), heavy).alias("y")))
    repeats = (F.size(F.array_distinct(a)) < F.size(a)) | (F.size(F.array_distinct(b)) < F.size(b))
    return repeats | F.exists(own, lambda p: passes(p["x"], p["y"]))


def _where_words(pairs: DataFrame, what: str, check: Callable[[list[str], list[str]], bool]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [check(x.split(), y.split()) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("u", "v"))
    return pairs.select("u", "v", f"{what}_u", f"{what}_v").mapInArrow(run, kinds)


def same_titles(pairs: DataFrame) -> DataFrame:
    """(u, v) of the rows (u, v, tokens_u, tokens_v) that pass the check of the title; equal words pass too, as short titles do."""
    return _where_words(pairs.where(worth_checking(F.col("tokens_u"), F.col("tokens_v"))), "tokens", lambda x, y: sorted(x) == sorted(y) or same_title(x, y))


def of_same_people(pairs: DataFrame) -> DataFrame:
    """(u, v) of the rows (u, v, people_u, people_v) that pass the check of the people."""
    return _where_words(pairs, "people", same_people)
