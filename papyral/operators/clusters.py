"""Clusters of recent papers: weighted terms, density clusters, labels, representatives, and keys that last from period to period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyral.functions import wordlists as L
from papyral.operators.lifecycle import jaccard_matches
from papyral.session import Scratch

MAX_FEATURES, MIN_CLUSTER, DAYS = 4000, 4, 30
#: Density clusters compare all pairs of one recent window: up to BLOCK vectors in one task, more of them block by block, a pair of
#: blocks a task.  Edges of the blocks' trees are thinned until at most EDGES are left for the task that makes the hierarchy.
BLOCK, EDGES = 4096, 4_000_000


def tokens(text: Column) -> Column:
    """Lower-case words of two characters and more without stop words, as the weighting counts them."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 2)
    return F.filter(words, lambda w: ~w.isin(*L.STOPWORDS))


def term_weights(docs: DataFrame, features: int = MAX_FEATURES) -> DataFrame:
    """(id, term, weight): TF-IDF of words and pairs of neighbouring words, smoothed, each document of length 1.

    docs: id, text.  The ``features`` terms that occur most often in all count (ties by term); idf = ln((1 + n) / (1 + df)) + 1.
    Documents without such a term have no row.
    """
    words = docs.select("id", tokens(F.col("text")).alias("w"))
    n = F.size("w")
    pairs = F.zip_with(F.slice("w", 1, F.greatest(n - 1, F.lit(0))), F.slice("w", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    counts = words.select("id", F.explode(F.concat("w", pairs)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    kept = counts.groupBy("term").agg(F.sum("tf").alias("all"), F.count("*").alias("df")).orderBy(F.desc("all"), "term").limit(features)
    size = docs.agg(F.count("*").alias("n"))
    idf = kept.crossJoin(F.broadcast(size)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(F.broadcast(idf), "term").withColumn("x", F.col("tf") * F.col("idf"))  # at most ``features`` rows
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("x") / F.col("norm")).alias("weight"))


def _distances(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((u * u).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * u @ v.T, 0.0))


def _tree(away: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """The spanning tree (distance, a, b), a < b, of mutual reachability, vertex by vertex."""
    n = len(away)
    inside, best, link = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    edges, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        reach = np.maximum(np.maximum(away[at], core), core[at])
        nearer = ~inside & (reach < best)
        best[nearer], link[nearer] = reach[nearer], at
        at = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((float(best[at]), *sorted((int(link[at]), at))))
    return edges


def _tree_across(away: np.ndarray, core_u: np.ndarray, core_v: np.ndarray) -> list[tuple[float, int, int]]:
    """The spanning tree (distance, row, column) of the edges between the rows and the columns of ``away``."""
    reach = np.maximum(np.maximum(away, core_v[None, :]), core_u[:, None])
    sides = (reach, np.ascontiguousarray(reach.T))  # from a row to the columns, from a column to the rows
    inside = [np.zeros(n, bool) for n in reach.shape]
    best = [np.full(n, np.inf) for n in reach.shape]  # inf for those inside too
    link = [np.zeros(n, int) for n in reach.shape]
    edges, side, at = [], 0, 0
    inside[0][0] = True
    for _ in range(sum(reach.shape) - 1):
        far, row = 1 - side, sides[side][at]
        nearer = ~inside[far] & (row < best[far])
        best[far][nearer], link[far][nearer] = row[nearer], at
        ends = [int(np.argmin(b)) for b in best]
        side = 0 if best[0][ends[0]] < best[1][ends[1]] else 1
        at = ends[side]
        edges.append((float(best[side][at]), *((at, int(link[side][at])) if side == 0 else (int(link[side][at]), at))))
        inside[side][at], best[side][at] = True, np.inf
    return edges


def _thinned(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The positions of the edges of a spanning forest of the least distance, shortest first."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.lexsort((b, a, d))
    top, kept = list(range(len(names))), []

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for k, x, y in zip(order.tolist(), ends[: len(a)][order].tolist(), ends[len(a) :][order].tolist()):
        x, y = find(x), find(y)
        if x != y:
            top[x] = y
            kept.append(k)
            if len(kept) == len(names) - 1:
                break
    return np.array(kept, np.int64)


def density_labels(v: np.ndarray, least: int = MIN_CLUSTER) -> np.ndarray:
    """A cluster number for each vector, -1 for noise: hierarchical density clusters chosen by excess of mass (Campello et al. 2013)."""
    n = len(v)
    if n < 2 * least:
        return np.full(n, -1)
    away = _distances(v, v)
    core = np.partition(away, min(least - 1, n - 1), axis=1)[:, min(least - 1, n - 1)]
    return hierarchy_labels(n, _tree(away, core), least)


def hierarchy_labels(n: int, edges: list[tuple[float, int, int]], least: int = MIN_CLUSTER) -> np.ndarray:
    """The cluster number of each of ``n`` points, -1 for noise, from the spanning tree (distance, a, b) of mutual reachability."""
    labels = np.full(n, -1)
    # Merges from the shortest edge on: a binary tree of the points.
    top, kids, height, size = list(range(n)), {}, {}, [1] * n + [0] * n

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for k, (d, a, b) in enumerate(sorted(edges)):
        node, x, y = n + k, find(a), find(b)
        top.append(node)
        top[x] = top[y] = node
        kids[node], height[node], size[node] = (x, y), d, size[x] + size[y]

    def points(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo += kids[x]
        return out

    # A cluster lives from its birth until it parts into two large enough; smaller parts fall out of it.
    stability, parts, todo, order = {}, {}, [(2 * n - 2, 0.0)], []
    while todo:
        root, birth = todo.pop()
        order.append(root)
        mass, node, parts[root] = 0.0, root, []
        while True:
            dense = 1.0 / height[node] if node >= n and height[node] > 0 else np.inf
            dense = min(dense, 1e12)
            if node < n:
                break
            x, y = kids[node]
            large = [z for z in (x, y) if size[z] >= least]
            if len(large) == 2:
                mass += size[node] * (dense - birth)
                parts[root] = [x, y]
                todo += [(x, dense), (y, dense)]
                break
            mass += sum(size[z] for z in (x, y) if z not in large) * (dense - birth)
            if not large:
                break
            node = large[0]
        stability[root] = mass
    chosen, worth = {}, {}
    for root in reversed(order):
        below = sum(worth[c] for c in parts[root])
        chosen[root] = root != 2 * n - 2 and (not parts[root] or stability[root] >= below)
        worth[root] = stability[root] if chosen[root] else below
    todo, number = [2 * n - 2], 0
    while todo:
        root = todo.pop(0)
        if chosen[root]:
            labels[points(root)] = number
            number += 1
        else:
            todo += parts[root]
    return labels


def _matrix(tab: pa.Table) -> np.ndarray:
    return tab.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(tab.num_rows, -1)


def _block_pairs(rows: DataFrame, blocks: int) -> DataFrame:
    """rows (i, block, ...) once for each pair of blocks that theirs is in, placed by ``pair``: each pair of rows meets in one."""
    low, high = F.least("block", "other"), F.greatest("block", "other")
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("pair", low * blocks + high).drop("other")
    return met.repartition(blocks * (blocks + 1) // 2, "pair").groupBy("pair")


def spanning_edges(vectors: DataFrame, n: int, least: int, scratch: Scratch) -> DataFrame:
    """(d, a, b) that hold a spanning tree of mutual reachability of the ``n`` rows (i, v), i from 0 to n - 1.

    An edge of the whole tree is one of the tree of any part of the edges that it is in, so each pair of blocks gives
    its own tree, the trees of neighbouring pairs give one, and so on.
    """
    blocks = -(-n // BLOCK)
    placed = vectors.withColumn("block", F.pmod("i", F.lit(blocks)).cast("int"))

    def sides(tab: pa.Table) -> list[pa.Table]:
        block = tab.column("block").to_numpy()
        return [tab.take(pa.array(np.flatnonzero(block == x))) for x in np.unique(block)]

    def nearest(key: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        parts, p = sides(tab), divmod(key[0].as_py(), blocks)
        away = _distances(_matrix(parts[0]), _matrix(parts[-1]))
        found = []
        for part, d in [(parts[0], away)] + ([(parts[1], away.T)] if p[0] != p[1] else []):
            k = min(least, d.shape[1])
            found.append((part.column("i").to_numpy(), np.partition(d, k - 1, axis=1)[:, :k]))
        return pa.table({"i": pa.array(np.concatenate([i for i, _ in found]), pa.int64()), "near": pa.array([row for _, d in found for row in d.tolist()], pa.list_(pa.float64()))})

    def tree(key: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        parts, p = sides(tab), divmod(key[0].as_py(), blocks)
        away = _distances(_matrix(parts[0]), _matrix(parts[-1]))
        numbers, cores = ([x.column(c).to_numpy() for x in (parts[0], parts[-1])] for c in ("i", "core"))
        edges = _tree(away, cores[0]) if p[0] == p[1] else _tree_across(away, *cores)
        d, a, b = (np.array(c) for c in zip(*edges)) if edges else (np.zeros(0), np.zeros(0, int), np.zeros(0, int))
        a, b = numbers[0][a], numbers[1][b]
        return pa.table({"p": pa.array([p[0]] * len(d), pa.int32()), "q": pa.array([p[1]] * len(d), pa.int32()), "d": pa.array(d, pa.float64()), "a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    def thin(key: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        return tab.take(pa.array(_thinned(*(tab.column(c).to_numpy() for c in ("d", "a", "b")))))

    near = _block_pairs(placed.select("i", "block", "v"), blocks).applyInArrow(nearest, "i bigint, near array<double>")
    core = near.groupBy("i").agg(F.array_sort(F.flatten(F.collect_list("near")))[least - 1].alias("core"))
    placed = scratch.save(placed.join(core, "i"), "cores")
    kind = "p int, q int, d double, a bigint, b bigint"
    edges = scratch.save(_block_pairs(placed.select("i", "block", "v", "core"), blocks).applyInArrow(tree, kind), "edges")
    while blocks > 1 and edges.count() > EDGES:
        blocks = -(-blocks // 8)
        eighth = lambda c: (F.col(c) / 8).cast("int").alias(c)
        fewer = edges.select(eighth("p"), eighth("q"), "d", "a", "b").repartition(blocks * (blocks + 1) // 2, "p", "q")
        edges = scratch.save(fewer.groupBy("p", "q").applyInArrow(thin, kind), "edges")
    return edges.select("d", "a", "b")


def density_clusters(vectors: DataFrame, least: int = MIN_CLUSTER) -> DataFrame:
    """(paper_id, label) of the vectors (paper_id, v) of one recent window; noise is left out.

    Fewer than two clusters' worth of vectors give no rows.  All pairs are compared, block by block; one task holds the
    edges of the spanning tree.
    """
    scratch = Scratch(vectors.sparkSession, "density")
    numbered = vectors.groupBy("paper_id").agg(F.min("v").alias("v")).withColumn("i", F.row_number().over(W.orderBy("paper_id")).cast("bigint") - 1)
    rows = scratch.save(numbered.select("i", "paper_id", "v"), "vectors")
    n = rows.count()
    label = "i bigint, label int"

    def made(number: np.ndarray, found: np.ndarray) -> Iterator[pd.DataFrame]:
        out = pd.DataFrame({"i": number, "label": found.astype("int32")})
        yield out[out["label"] >= 0]

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if parts:
            every = pd.concat(parts).sort_values("i")
            yield from made(every["i"].to_numpy(), density_labels(np.array(every["v"].tolist(), np.float64), least))

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        if parts:
            d, a, b = (np.concatenate([f[c].to_numpy() for f in parts]) for c in ("d", "a", "b"))
            kept = _thinned(d, a, b)
            yield from made(np.arange(n), hierarchy_labels(n, list(zip(d[kept].tolist(), a[kept].tolist(), b[kept].tolist())), least))

    if n <= max(BLOCK, 2 * least):
        found = rows.select("i", "v").repartition(1).mapInPandas(whole, label)
    else:
        found = spanning_edges(rows.select("i", "v"), n, least, scratch).repartition(1).mapInPandas(joined, label)
    return rows.select("i", "paper_id").join(found, "i").select("paper_id", "label")


def label_terms(members: DataFrame, weights: DataFrame, k: int = 6) -> DataFrame:
    """(label, term, weight, place): the k terms of greatest mean weight over a cluster's members; a member without the term counts 0."""
    sizes = members.groupBy("label").agg(F.count("*").alias("n"))
    total = members.join(weights.withColumnRenamed("id", "paper_id"), "paper_id").groupBy("label", "term").agg(F.sum("weight").alias("s"))
    mean = total.join(sizes, "label").select("label", "term", (F.col("s") / F.col("n")).alias("weight"))
    place = F.row_number().over(W.partitionBy("label").orderBy(F.desc(F.round("weight", 9)), "term"))
    return mean.withColumn("place", place).where(F.col("place") <= k)


def representatives(members: DataFrame, vectors: DataFrame, k: int = 3) -> DataFrame:
    """(label, paper_id, distance, place): the k members nearest to the cluster's mean vector."""
    rows = members.join(vectors.select("paper_id", "v"), "paper_id")
    mean = rows.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("c"))
    gap = F.sqrt(F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    near = rows.join(mean, "label").select("label", "paper_id", gap.alias("distance"))
    place = F.row_number().over(W.partitionBy("label").orderBy(F.round("distance", 9), "paper_id"))
    return near.withColumn("place", place).where(F.col("place") <= k)


def carried_keys(members: DataFrame, previous: DataFrame, period: str) -> DataFrame:
    """(label, cluster_key, size, prev_size): a cluster takes the key of the earlier one it overlaps by half, else a new one.

    members: (label, paper_id); previous: (cluster_key, paper_id) of the last period.  An earlier key goes to one cluster only.  A
    new key is the period and a hash of the first five members in order.
    """
    now = members.select(F.col("label").alias("cluster"), F.col("paper_id").alias("member"))
    then = previous.select(F.col("cluster_key").alias("cluster"), F.col("paper_id").alias("member"))
    match = jaccard_matches(now, then).select(F.col("cluster").alias("label"), F.col("previous").alias("old"))
    sizes = then.groupBy(F.col("cluster").alias("old")).agg(F.count_distinct("member").alias("prev_size"))
    first = F.slice(F.array_sort(F.collect_set("paper_id")), 1, 5)
    fresh = members.groupBy("label").agg(F.count_distinct("paper_id").alias("size"), F.concat(F.lit(f"{period}:"), F.substring(F.sha1(F.array_join(first, "|").cast("binary")), 1, 10)).alias("made"))
    return fresh.join(match, "label", "left").join(sizes, "old", "left").select("label", F.coalesce("old", "made").alias("cluster_key"), "size", "prev_size")


def cluster_recent(papers: DataFrame, vectors: DataFrame, previous: DataFrame, as_of: Column, period: str, days: int = DAYS, least: int = MIN_CLUSTER) -> DataFrame:
    """(period, cluster_key, label_terms, member_paper_ids, representative_paper_ids, size, prev_size) of the last ``days``."""
    recent = papers.where(~F.coalesce("muted", F.lit(False)) & (F.coalesce("announce_date", F.to_date("first_seen_at")) > F.date_sub(as_of, days)))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    docs = recent.join(vectors.select("paper_id"), "paper_id", "left_semi").select(F.col("paper_id").alias("id"), text.alias("text"))
    own = vectors.join(docs.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    members = density_clusters(own, least)
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("place", c))), lambda x: x[c])
    terms = label_terms(members, term_weights(docs)).groupBy("label").agg(in_order("term").alias("label_terms"))
    near = representatives(members, own).groupBy("label").agg(in_order("paper_id").alias("representative_paper_ids"))
    ids = members.groupBy("label").agg(F.array_sort(F.collect_set("paper_id")).alias("member_paper_ids"))
    out = carried_keys(members, previous, period).join(ids, "label").join(near, "label").join(terms, "label", "left")
    return out.select(F.lit(period).alias("period"), "cluster_key", F.coalesce("label_terms", F.array().cast("array<string>")).alias("label_terms"), "member_paper_ids", "representative_paper_ids", "size", "prev_size")


def rollup(clusters: DataFrame, n: int = 12) -> DataFrame:
    """The largest clusters of the last period, with ``is_new``."""
    last = clusters.agg(F.max("period").alias("period"))
    return clusters.join(F.broadcast(last), "period", "left_semi").withColumn("is_new", F.col("prev_size").isNull()).orderBy(F.desc("size"), "cluster_key").limit(n)
