"""Consolidating pairwise matches into groups: connected components by random contraction.

Each round every vertex hooks to the neighbour (or itself) whose hash under a fresh
seed is smallest; the edges are relabelled to the hooked vertices, loops and repeats are
dropped, and the next round works on what is left.  The expected number of vertices that
still have edges falls by a constant factor a round, whatever the shape of the graph, so
long chains cost as little as stars.  The per-round mappings are expanded backwards at
the end.  Only 64-bit keys are shuffled, minima are taken before the shuffle, and
every round is a written table, so no lineage grows and nothing is collected but the list of heavy keys: vertices and
roots with at least a thousandth of a table's rows (a thousand at most), whose rows the joins spread by a salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyral.functions.identifiers import clean_arxiv, clean_doi
from papyral.session import HEAVY, Scratch, spread_join, table

#: A graph of ``n`` vertices needs about log(n) / log(4/3) rounds; this is far beyond any real one.
MAX_ROUNDS = 200
#: Tables of fewer rows are not looked through for heavy keys: one task holds them.
FEW = 100_000


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (columns ``u``, ``v``, any one atomic type).

    ``component`` is one of the component's vertices.  Null ends and loops link nothing (a vertex that has
    only a loop is not returned); repeats and direction do not matter.  An empty table gives no rows.  Other types than
    bigint are contracted as 64-bit hashes (at a billion vertices 0.03 pairs are expected to share one).
    """
    scratch = Scratch(spark, "components")
    sound = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    if dict(edges.dtypes)["u"] == "bigint":  # already hashes
        return contract(spark, scratch, sound).select(F.col("x").alias("vertex"), F.col("r").alias("component"))
    coded = sound.select("u", "v", F.xxhash64("u").alias("hu"), F.xxhash64("v").alias("hv"))
    coded = scratch.save(coded, "coded")
    final = contract(spark, scratch, coded.select(F.col("hu").alias("u"), F.col("hv").alias("v")))
    names = coded.select(F.inline(F.array(F.struct(F.col("hu").alias("x"), F.col("u").alias("vertex")), F.struct(F.col("hv").alias("x"), F.col("v").alias("vertex"))))).distinct()
    named = names.join(final, "x").select("vertex", "r")
    root = named.groupBy("r").agg(F.min("vertex").alias("component"), F.count("*").alias("n"))
    named, root = scratch.save(named, "named"), scratch.save(root, "root")
    return spread_join(named, root.drop("n"), "r", _heavy(root, "r", named.count())).select("vertex", "component")


def _heavy(counted: DataFrame, key: str, rows: int) -> list:
    """The keys of ``counted`` (key, n) that hold the share HEAVY of ``rows`` rows: 1 / HEAVY at most."""
    if rows < FEW:
        return []
    return [r[key] for r in counted.where(F.col("n") >= HEAVY * rows).select(key).collect()]


def contract(spark: SparkSession, scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(x, r): the root of every vertex of ``edges`` (bigint)."""
    current = scratch.save(_undirected(edges), "edges")
    maps: list[DataFrame] = []
    sizes: list[int] = []
    for k in range(MAX_ROUNDS):
        size = current.count()
        if not size:
            break
        hashed = lambda c, k=k: F.xxhash64(F.lit(k), c)
        sides = current.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))))
        least = sides.groupBy("x").agg(F.min_by("y", hashed(F.col("y"))).alias("y"), F.count("*").alias("n"))
        hook = F.when(hashed(F.col("x")) < hashed(F.col("y")), F.col("x")).otherwise(F.col("y"))
        mapping = scratch.save(least.select("x", hook.alias("r"), "n"), f"map{k}")
        maps.append(mapping)
        sizes.append(size)
        hubs = _heavy(mapping.withColumnRenamed("x", "u"), "u", size)
        left, right = mapping.select(F.col("x").alias("u"), F.col("r").alias("ru")), mapping.select(F.col("x").alias("v"), F.col("r").alias("rv"))
        moved = spread_join(spread_join(current, left, "u", hubs), right, "v", hubs)
        after = scratch.save(_undirected(moved.select(F.col("ru").alias("u"), F.col("rv").alias("v"))), "edges")
        scratch.drop(current)
        current = after
    else:
        raise RuntimeError("the contraction did not end")
    scratch.drop(current)
    if not maps:
        return spark.createDataFrame([], "x bigint, r bigint")
    # Backwards: a round's mapping is followed by the mapping of the later rounds where that has the vertex.
    final = maps[-1].select("x", "r")
    for mapping, size in zip(reversed(maps[:-1]), reversed(sizes[:-1])):
        later = final.select(F.col("x").alias("r"), F.col("r").alias("root"))
        if size < FEW:
            followed = mapping.select("x", "r").join(later, "r", "left")
        else:  # every spoke of a hub has the same root
            roots = mapping.groupBy("r").agg(F.count("*").alias("n"))
            whole = roots.select("r").join(later, "r", "left")
            followed = spread_join(mapping.select("x", "r"), whole, "r", _heavy(roots, "r", size))
        final = followed.select("x", F.coalesce("root", "r").alias("r"))
    final = scratch.save(final, "roots")
    scratch.drop(*maps)
    return final


def _undirected(edges: DataFrame) -> DataFrame:
    low, high = F.least("u", "v"), F.greatest("u", "v")
    return edges.where(F.col("u") != F.col("v")).select(low.alias("u"), high.alias("v")).distinct()


def latest_verdicts(pairs: DataFrame) -> DataFrame:
    """(u, v) of the pairs whose latest verdict is ``same``, in either order of the keys.

    At one instant ``same`` gives way to any other verdict.  A null instant is older than any.
    Pairs with a null key, self pairs and null verdicts link nothing.
    """
    apart = (F.lower(F.trim("verdict")) != "same").cast("bigint")
    rows = pairs.where(F.col("left_key").isNotNull() & F.col("right_key").isNotNull() & F.col("verdict").isNotNull() & (F.col("left_key") != F.col("right_key")))
    # One number orders the verdicts of a pair: the instant, then whether they part (a null instant before all).
    at = F.coalesce(F.unix_micros("decided_at"), F.lit(-(1 << 61)))
    rows = rows.select(F.least("left_key", "right_key").alias("u"), F.greatest("left_key", "right_key").alias("v"), (at * 2 + apart).alias("d"))
    return rows.groupBy("u", "v").agg(F.max("d").alias("d")).where(F.pmod("d", F.lit(2)) == 0).select("u", "v")


def identifier_links(papers: DataFrame) -> DataFrame:
    """(u, v): each paper's key tied to its clean DOI and its clean preprint number, a vertex of its own each.

    A star per identifier: an identifier shared by a third of all rows adds as many edges, not their square.
    """
    named = F.array(F.concat(F.lit("\u0001doi "), clean_doi(F.col("doi"))), F.concat(F.lit("\u0001arxiv "), clean_arxiv(F.col("arxiv_id"))))
    rows = papers.where(F.col("canonical_key").isNotNull()).select(F.col("canonical_key").alias("u"), F.explode(named).alias("v"))
    return rows.where(F.col("v").isNotNull())


def paper_groups(spark: SparkSession, papers: DataFrame, pairs: DataFrame) -> DataFrame:
    """(canonical_key, group_key) of every papers row whose group has two or more canonical keys.

    group_key is the smallest canonical key of the group that is in papers.  Keys that are in ``pairs``
    only still link others and count as keys of the group.
    """
    scratch = Scratch(spark, "groups")
    code = lambda c: F.xxhash64(c)
    verdicts = scratch.save(latest_verdicts(pairs), "verdicts")
    ties = identifier_links(papers).unionByName(verdicts).select(code(F.col("u")).alias("u"), code(F.col("v")).alias("v"))
    final = contract(spark, scratch, ties)
    # Names come back once: the keys of papers, and those that only pairs know.
    known = papers.where(F.col("canonical_key").isNotNull()).select(F.col("canonical_key").alias("name"), F.lit(True).alias("known"))
    only = verdicts.select(F.explode(F.array("u", "v")).alias("name"), F.lit(False).alias("known"))
    names = known.unionByName(only).groupBy("name").agg(F.max("known").alias("known")).select(code(F.col("name")).alias("x"), "name", "known")
    members = scratch.save(names.join(final, "x").select("r", "name", "known"), "members")
    # One aggregate a component, partial before the shuffle; then back to the members, the rows of large ones spread.
    roots = scratch.save(members.groupBy("r").agg(F.count("*").alias("n"), F.min(F.when(F.col("known"), F.col("name"))).alias("group_key")).where("n >= 2"), "groups")
    return spread_join(members.where("known"), roots.drop("n"), "r", _heavy(roots, "r", members.count())).select(F.col("name").alias("canonical_key"), "group_key")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paper_groups(spark, table(spark, sf_dir, "papers"), table(spark, sf_dir, "match_pairs"))
