"""Variant spellings of names typed by people: linked by MinHash banding, Monge-Elkan similarity and stars.

1. Every distinct string is taken apart into family part, given name and initials.  Which words are given names is learnt
   from where they stand in all names.
2. Families that differ by slips are found by MinHash banding over padded q-grams, the given name's first letter being
   part of each band.  Rows and bands are read off the collision curve 1 - (1 - J^rows)^bands for each length: J is what one
   slip leaves of the q-grams, and the bands are as many as it takes to meet with RECALL (see
   :func:`banding`), so short families are found as surely as long ones.  Candidates are verified by Monge-Elkan similarity.
3. Within a family and letter, names are compared by Monge-Elkan similarity with the parts' conflicts (another given
   name, another middle initial) ruled out, and clustered by stars: the most frequent full spelling is
   the centre, the others join the centre they are most similar to.

Work on distinct strings only, so a name on a third of all rows is one string.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyral.llm.works import fold, near
from papyral.session import Scratch, table

#: Length of the q-grams; the share of families one slip apart that must meet; the most bands.
Q, RECALL, MOST = 2, 0.97, 32
#: Given names: words of at least MIN_GIVEN names that stand first in most of them.  Up to SMALL_LIST of them are broadcast;
#: a longer list is joined to the names' words instead, with the same result.
MIN_GIVEN, SMALL_LIST, FIRST_SHARE = 5, 50_000, 0.6
#: A name of initials joins the person that has at least this share of the spellings' occurrences it could stand for.
INITIAL_SHARE = 0.5
#: Monge-Elkan similarity from which two spellings are one: a slip in a word of four letters or more, two in one of nineteen.
SIMILAR = 0.8

# Common short forms of given names.
NICKNAMES = {
    "alex": "alexander", "andy": "andrew", "annie": "anna", "becky": "rebecca", "bella": "isabella", "ben": "benjamin", "beth": "elizabeth", "bill": "william",
    "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine", "charlie": "charles", "chris": "christopher", "dan": "daniel", "dani": "daniela",
    "danny": "daniel", "dave": "david", "debbie": "deborah", "dick": "richard", "dora": "theodora", "ed": "edward", "franca": "francesca", "fred": "frederik",
    "gabe": "gabriel", "greg": "gregory", "jack": "john", "jen": "jennifer", "jim": "james", "jimmy": "james", "joe": "joseph", "jon": "jonathan",
    "kate": "katharina", "kathi": "katharina", "kathy": "katharina", "ken": "kenneth", "kolya": "nikolai", "larry": "lawrence", "leo": "leonardo", "liz": "elizabeth",
    "maggie": "margaret", "matt": "matthias", "max": "maximilian", "meg": "margaret", "mike": "michael", "nick": "nicholas", "pat": "patricia", "peggy": "margaret",
    "pete": "peter", "phil": "philip", "pip": "philippa", "rob": "robert", "ron": "ronald", "sam": "samuel", "steffi": "stephanie", "steve": "stephen",
    "sue": "susan", "ted": "theodore", "tom": "thomas", "tony": "anthony", "vicky": "victoria", "will": "william", "zoli": "zoltan",
}
TYPES = {
    "laboratory": "laboratory", "lab": "laboratory", "labs": "laboratory", "laboratories": "laboratory", "institute": "institute", "inst": "institute", "centre": "centre", "center": "centre", "ctr": "centre",
    "consortium": "consortium", "consort": "consortium", "collaboration": "collaboration", "collab": "collaboration", "wg": "group", "group": "group", "grp": "group", "working": "", "university": "university",
    "univ": "university", "hospital": "hospital", "hosp": "hospital", "team": "team", "network": "network", "initiative": "initiative", "project": "project", "society": "society", "department": "department",
    "dept": "department", "college": "college", "school": "school", "foundation": "foundation", "committee": "committee", "association": "association", "alliance": "alliance",
}
PARTICLES = frozenset("van von de del der den el la le da di du dos mc al bin ter ten".split())
TITLES = frozenset("dr prof professor mr mrs ms phd md msc bsc jr sr".split())
MARKS = re.compile(r"[\d¹²³⁰-⁹*†‡§¶#]+")
NOBODY = re.compile(r"^\W*(?:et\.? ?al\.?|and others|others|anonymous|unknown|n/?a)\W*$", re.I)
WORDS = re.compile(r"[a-z]+")
BRACKETS = re.compile(r"\([^)]*\)")


def name_words(raw: str) -> tuple[list[str], list[str] | None, bool] | None:
    """(words, family words or None if not marked, organisation) of a string; None if it names nobody.

    Words are folded; hyphens and apostrophes inside a word are dropped.
    """
    if not raw or NOBODY.match(raw):
        return None
    s = MARKS.sub("", raw.replace("\xa0", " "))
    s = BRACKETS.sub(" ", s)
    s = re.sub(r",?\s*\b(?:ph\.?\s?d|m\.?d|m\.?sc|jr|sr)\b\.?\s*$", "", s, flags=re.I)
    plain = fold(s)
    bare = WORDS.findall(plain)
    if not bare:
        return None
    if any(w in TYPES for w in bare):
        return [w for w in bare if w not in ("the", "for", "of")], None, True
    head, comma, tail = s.partition(",")

    def words(part: str) -> list[str]:
        out: list[str] = []
        for w in part.split():
            if "." in w.strip("."):  # F.M. or J.-M.
                w = w.replace(".", " ").replace("-", " ")
            for x in w.split():
                y = "".join(WORDS.findall(fold(x)))
                if y and y not in TITLES:
                    out += list(y) if len(y) <= 3 and x.isupper() and len(part.split()) > 1 and (len(y) == 1 or not _vowelled(y) or len(y) == 2) else [y]
        return out

    if comma and tail.strip():
        family, rest = words(head.title()), words(tail)
        return [*rest, *family], family, False
    tokens = s.split()
    caps = [t for t in tokens if len(WORDS.findall(fold(t))) and len("".join(WORDS.findall(fold(t)))) > 3 and t.upper() == t and any(c.isalpha() for c in t)]
    if caps and len(caps) < len([t for t in tokens if len(t.strip(".")) > 2]):
        # Capital particles beside a long word belong to it (VAN DIJK).
        own = [t for t in tokens if t in caps or (t.isupper() and t.lower() in PARTICLES)]
        family = [x for t in own for x in words(t.title())]
        rest = [x for t in tokens if t not in own for x in words(t if len(t) > 3 or not t.isupper() else t + ".")]
        return [*rest, *family], family, False
    return words(s), None, False


def _vowelled(w: str) -> bool:
    return any(c in "aeiouy" for c in w)


def parse_name(raw: str, given_names: frozenset[str] | set[str]) -> tuple[str, str, str, str, str] | None:
    """(kind, family, given, initials, letter): given is '' if only initials are there; initials are those after it, or all.

    kind 'o': family is the sorted own words of an organisation, given its sorted type words.
    """
    parsed = name_words(raw)
    if parsed is None:
        return None
    words, family, organisation = parsed
    if organisation:
        own = sorted(w for w in words if w not in TYPES)
        kinds = sorted({TYPES[w] for w in words if w in TYPES and TYPES[w]})
        return ("o", "".join(own), " ".join(kinds), "", (kinds or ["-"])[0][0]) if own else None
    if family is None:
        full = [w for w in words if len(w) > 1]
        if not full:
            return None
        if len(words) > 1 and len(words[-1]) == 1:  # initials stand last: Doe J
            family = full
            if len(full) > 1 and full[0] in given_names and full[0] == words[0]:
                family = full[1:]
        elif len(full) == 1:
            family = full
        elif full[-1] in given_names and full[0] not in given_names and words[0] == full[0]:
            family = [w for w in full[:-1]]
        else:
            n = 2 if len(full) > 2 and full[0] + full[1] in given_names and full[0] + full[1] not in full else 1
            if len(words[0]) == 1:
                n = 0
            family = full[n:] or full[-1:]
    rest = list(words)
    for w in family:
        if w in rest:
            rest.reverse()
            rest.remove(w)
            rest.reverse()
    given_words = [w for w in rest if len(w) > 1]
    initials = "".join(w for w in rest if len(w) == 1)
    given = "".join(given_words)
    given = NICKNAMES.get(given, given)
    key = "".join(family)
    letter = (given or initials or "-")[0]
    return "p", key, given, initials, letter


def monge_elkan(a: list[str], b: list[str]) -> float:
    """The mean, over the words of the shorter name, of the best similarity to a word of the other."""
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    return sum(max(_word(x, y) for y in b) for x in a) / len(a)


def _word(x: str, y: str) -> float:
    """1 less the square of the edits (a swap of neighbours is one) over the longer length and one; 0.9 for a fitting initial."""
    if x == y:
        return 1.0
    if len(x) == 1 or len(y) == 1:
        return 0.9 if x[0] == y[0] else 0.0
    return 1 - _edits(x, y) ** 2 / (1 + max(len(x), len(y)))


def similar(x: str, y: str) -> float:
    """The Monge-Elkan similarity of two single words where it is SIMILAR at least, else 0.

    Two edits are too many for words so short that they bring it under SIMILAR, so for those no table of edits is made.
    """
    if x != y and len(x) > 1 < len(y) and 1 - 2**2 / (1 + max(len(x), len(y))) < SIMILAR and not near(x, y):
        return 0.0
    found = monge_elkan([x], [y])
    return found if found >= SIMILAR else 0.0


def _edits(x: str, y: str) -> int:
    if near(x, y):
        return 1
    if abs(len(x) - len(y)) > 2:
        return abs(len(x) - len(y))
    before, row = [0] * (len(y) + 1), list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row, up = before, [i] + [0] * len(y), row
        for j, d in enumerate(y, 1):
            row[j] = min(up[j] + 1, row[j - 1] + 1, up[j - 1] + (c != d))
            if i > 1 and j > 1 and c == y[j - 2] and d == x[i - 2]:
                row[j] = min(row[j], last[j - 2] + 1)
        before = up
    return row[-1]


def _grams(text: str) -> list[str]:
    s = "^" * (Q - 1) + text + "$" * (Q - 1)
    return list({s[i : i + Q] for i in range(len(s) - Q + 1)})


@lru_cache(maxsize=64)
def banding(length: int) -> tuple[int, int]:
    """(rows, bands) for words of which the longer has ``length`` letters: the most rows that MOST bands can serve at RECALL.

    The slip that costs most q-grams decides: two neighbouring letters swapped change Q + 1 of them.  Two rows at least, with as
    many bands as that takes: one row alone would put all families with a common letter pair into one bucket.
    """
    grams = length + Q - 1
    j = max(grams - Q - 1, 1) / (grams + Q + 1)
    for rows in (6, 5, 4, 3, 2):
        bands = math.ceil(math.log(1 - RECALL) / math.log(1 - j**rows))
        if bands <= MOST or rows == 2:
            return rows, bands


_RNG = np.random.default_rng(7)
_A = _RNG.integers(1, 2**61, 6 * MOST, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**61, 6 * MOST, dtype=np.uint64)


@lru_cache(maxsize=20_000)
def _minima(gram: str) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (np.uint64(xxhash.xxh64_intdigest(gram)) * _A + _B) >> np.uint64(11)


def band_keys(text: str, letter: str) -> list[int]:
    """Band keys of a family: those of its own length and, as a partner may be a letter longer, of the next."""
    m = np.minimum.reduce([_minima(g) for g in _grams(text)])
    out = []
    # No slip in words of three letters is similar enough, so those have no bands of their own length.
    for rows, bands in {banding(min(n, 40)) for n in (len(text), len(text) + 1) if n > 3}:
        head = letter.encode() + bytes([rows, bands])
        packed = m[: rows * bands].tobytes()
        out += [xxhash.xxh64_intdigest(head + bytes([b]) + packed[8 * rows * b : 8 * rows * (b + 1)]) - (1 << 63) for b in range(bands)]
    return out


def star_clusters(items: list[tuple[str, int, str, str, str, str]], family: str) -> list[int]:
    """The cluster number of each item (name, n, kind, own family, given, initials) of one family and letter; -1 for none.

    Centres are the full given names with their middle initials, most frequent first; ties by code point.
    """
    cluster = [-1] * len(items)
    weight: dict[tuple[str, str], int] = defaultdict(int)  # (given, middle) -> occurrences, own family only
    for _, n, _, own, given, initials in items:
        if given and own == family:
            weight[given, initials[:1]] += n
    by_given: dict[str, int] = defaultdict(int)
    for (g, _), n in weight.items():
        by_given[g] += n
    # Stars of given names: a rarer spelling joins the most frequent one that it resembles.
    centre: dict[str, str] = {}
    stars: list[str] = []
    for g in sorted(by_given, key=lambda g: (-by_given[g], g)):
        best = max(((like, by_given[c], c) for c in stars if abs(len(g) - len(c)) <= 2 and (like := similar(g, c))), default=None)
        centre[g] = best[2] if best else g
        if centre[g] == g:
            stars.append(g)
    people: dict[tuple[str, str], int] = {}
    middles: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for (g, m), n in weight.items():
        middles[centre[g]][m] += n

    def person(given: str, middle: str) -> tuple[str, str] | None:
        known = {m: n for m, n in middles[given].items() if m}
        if len(known) <= 1:
            return given, ""
        if middle:
            return given, middle
        best = max(known, key=lambda m: (known[m], m))
        return (given, best) if known[best] >= 0.6 * sum(known.values()) else (given, "?")

    sums: dict[tuple[str, str], int] = defaultdict(int)
    for (g, m), n in weight.items():
        sums[person(centre[g], m)] += n

    def number(p) -> int:
        return people.setdefault(p, len(people))

    late: list[int] = []
    for i, (_, _, _, own, given, initials) in enumerate(items):
        if not given:
            late.append(i)
            continue
        g = given
        if own == family:
            g = centre[given]
        elif g in centre:
            g = centre[g]
        else:
            near_by = [c for c in stars if similar(g, c)]
            if not near_by:
                cluster[i] = number(("\x00" + own, given))  # a family of its own after all
                continue
            g = max(near_by, key=lambda c: (by_given[c], c))
        cluster[i] = number(person(g, initials[:1]))
    for i in late:
        _, n, _, own, _, initials = items[i]
        if not initials:
            cluster[i] = number(("\x00" + own, "-"))
            continue
        fits: dict[tuple[str, str], float] = {}
        for p, w in sums.items():
            g, m = p
            if g[0] != initials[0]:
                continue
            if len(initials) > 1:
                own_middles = {x for x in middles[g] if x}
                second = initials[1]
                if m and m not in ("?", second):
                    continue
                if own_middles and second not in own_middles and not _second_part(g, second):
                    continue
                w = w * (3.0 if second in own_middles else 1.0)
            fits[p] = w
        if fits:
            best = max(fits, key=lambda p: (fits[p], p))
            if fits[best] >= INITIAL_SHARE * sum(fits.values()):
                cluster[i] = number(best)
                continue
        cluster[i] = number(("\x00" + own, initials[:1]))
    return cluster


def _second_part(given: str, letter: str) -> bool:
    """Whether a double given name (hyphen dropped) may have a second part with this letter."""
    return len(given) >= 6 and letter in given[2:-1]


SCHEMA = "name string, n bigint, kind string, family string, given string, initials string, letter string"


def parsed_names(names: DataFrame, given: DataFrame) -> DataFrame:
    """SCHEMA rows of names (name, n); given: (word) of the given names."""
    spark = names.sparkSession
    small = given.count() <= SMALL_LIST
    shared = spark.sparkContext.broadcast(frozenset(r["word"] for r in given.collect()) if small else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [shared.value] * batch.num_rows if batch.num_columns == 2 else [frozenset(g or ()) for g in batch.column(2).to_pylist()]
            rows = [(i, p) for i, (x, g) in enumerate(zip(batch.column(0).to_pylist(), known)) if (p := parse_name(x, g)) and p[1]]
            at = pa.array([i for i, _ in rows], pa.int64())
            parts = zip(*(p for _, p in rows)) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, pa.string()) for c in parts)], names=["name", "n", "kind", "family", "given", "initials", "letter"])

    if small:
        return names.select("name", "n").mapInArrow(run, SCHEMA)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = set()
            for x in batch.column(0).to_pylist():
                full = [w for w in (name_words(x) or ([],))[0] if len(w) > 1]
                pairs.update((x, w) for w in (*full, *(full[0] + w for w in full[1:2])))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.string()), pa.array([w for _, w in pairs], pa.string())], names=["name", "word"])

    hit = names.select("name").mapInArrow(words, "name string, word string").join(given, "word").groupBy("name").agg(F.collect_set("word").alias("given"))
    return names.select("name", "n").join(hit, "name", "left").select("name", "n", "given").mapInArrow(run, SCHEMA)


def given_names(names: DataFrame) -> DataFrame:
    """(word): words that stand first in most of the names they are in, by distinct strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for x in batch.column(0).to_pylist():
                p = name_words(x)
                if p is None or p[2]:
                    continue
                words, family, _ = p
                if family is not None:
                    first, rest = [w for w in words if w not in family], family
                else:
                    if len(words[-1]) == 1:
                        first, rest = [], words
                    else:
                        first, rest = words[:1], words[1:]
                for w in first:
                    if len(w) > 2:
                        count[w][0] += 1
                for w in rest:
                    if len(w) > 2:
                        count[w][1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array([c[0] for c in count.values()], pa.int64()), pa.array([c[1] for c in count.values()], pa.int64())], names=["word", "first", "other"])

    words = names.select("name").mapInArrow(run, "word string, first bigint, other bigint")
    total = words.groupBy("word").agg(F.sum("first").alias("first"), F.sum("other").alias("other"))
    return total.where((F.col("first") >= MIN_GIVEN) & (F.col("first") >= FIRST_SHARE * (F.col("first") + F.col("other")))).select("word")


def name_clusters(spark: SparkSession, authors: DataFrame) -> DataFrame:
    """(name, n, cluster) of every distinct string of the array column ``authors`` that names somebody.

    Strings are compared as they stand; null arrays, null and empty strings and "et al." name nobody.
    """
    scratch = Scratch(spark, "names")
    names = scratch.save(authors.select(F.explode("authors").alias("name")).where(F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("n")), "names")
    parsed = scratch.save(parsed_names(names, scratch.save(given_names(names), "given")), "parsed")
    families = parsed.groupBy("kind", "family", "letter").agg(F.count("*").alias("spellings"), F.sum("n").alias("n"))

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(f, k + x) for k, f, x in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(ks) for ks in keys]), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k for ks in keys for k in ks], pa.int64()), *(batch.column(i).take(at) for i in (0, 1, 2, 4))], names=["band", "kind", "family", "letter", "n"])

    kind = "band bigint, kind string, family string, letter string, n bigint"
    banded = families.select("kind", "family", "letter", "spellings", "n").mapInArrow(bands, kind)
    # A family joins a more frequent one only, so each bucket's pairs are directed.
    rare = banded.select("band", "kind", "letter", F.col("family").alias("u"), F.col("n").alias("nu"))
    often = banded.select("band", "kind", "letter", F.col("family").alias("v"), F.col("n").alias("nv"))
    # Sorted on both sides: the planner takes banded to be as small as families, and would send all of it through the driver.
    met = rare.hint("merge").join(often, ["band", "kind", "letter"]).where(((F.col("nv") > F.col("nu")) | ((F.col("nv") == F.col("nu")) & (F.col("v") < F.col("u")))) & (F.levenshtein("u", "v", 2) >= 1)).select("kind", "letter", "u", "v", "nv").distinct()

    def slips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([similar(a, b) > 0 for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_()))

    linked = met.mapInArrow(slips, "kind string, letter string, u string, v string, nv bigint")
    star = linked.groupBy("kind", "letter", F.col("u").alias("family")).agg(F.max(F.struct("nv", "v")).alias("m")).select("kind", "letter", "family", F.col("m.v").alias("centre"))
    star = scratch.save(star, "stars")
    # A centre that itself joins another is no centre: its spokes stay with it one step only.
    rooted = star.hint("merge").join(star.select("kind", "letter", F.col("family").alias("centre"), F.col("centre").alias("up")), ["kind", "letter", "centre"], "left").select("kind", "letter", "family", F.coalesce("up", "centre").alias("centre"))
    placed = parsed.hint("merge").join(rooted, ["kind", "letter", "family"], "left").withColumn("root", F.coalesce("centre", "family"))

    def labels(kind: str, root: str, rows: list[tuple]) -> list:
        if len(rows) == 1:
            return [0]
        if kind == "o":
            known = {r[4] for r in rows if r[3] == root}
            return [r[4] if r[4] in known or r[3] == root else r[3] + "|" + r[4] for r in rows]
        return star_clusters(rows, root)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Clusters of rows sorted by group: most groups are a few rows, so they are told apart here and not sent one by one."""
        held: list[tuple] = []
        of, made = None, ([], [], [])

        def add() -> None:
            head = "\x1f".join(of)
            made[0].extend(r[0] for r in held)
            made[1].extend(r[1] for r in held)
            made[2].extend(f"{head}\x1f{x}" for x in labels(of[0], of[1], held))

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(made[0], pa.string()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.string())], names=["name", "n", "cluster"])
            for x in made:
                x.clear()
            return out

        for batch in batches:
            name, n, kind, family, given, initials, letter, root = (c.to_pylist() for c in batch.columns)
            for key, row in zip(zip(kind, root, letter), zip(name, n, kind, family, given, initials)):
                if key != of:
                    if held:
                        add()
                    of, held = key, []
                held.append(row)
            if len(made[0]) >= 10_000:
                yield full()
        if held:
            add()
        yield full()

    by_group = placed.select("name", "n", "kind", "family", "given", "initials", "letter", "root").repartition("kind", "root", "letter").sortWithinPartitions("kind", "root", "letter")
    return by_group.mapInArrow(groups, "name string, n bigint, cluster string")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = Scratch(spark, "pairs").save(name_clusters(spark, table(spark, sf_dir, "raw_papers")).select("name", "cluster"), "clusters")
    other = clusters.select("cluster", F.col("name").alias("name_b"))
    return clusters.select("cluster", F.col("name").alias("name_a")).hint("merge").join(other, "cluster").where("name_a < name_b").select("name_a", "name_b")
