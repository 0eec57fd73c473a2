"""Most similar vectors for every vector: collision-counting hashing inside pivot cells.

Every usable vector is assigned to the cells of its nearest pivots (a bounded sample of the
vectors), which is only a way to spread the work: all vectors are indexed, each in
``CELLS`` cells.  Inside a cell the search is by collision counting: vectors are projected on
``PROJECTIONS`` random lines, one sorted array a line; a query opens a window around its own
projection in every array, and a vector that lies in the windows of at least a threshold of
lines is a candidate, verified by its exact cosine.  Virtual rehashing: queries that have not
yet k verified neighbours widen their windows, without another index, until the window holds
the whole cell.  A cell that is too large is split again by pivots of its own.

Work grows with n times the cell size, not with n squared; the shuffles carry each vector
``CELLS`` times and at most k neighbours of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyral.session import HEAVY, Scratch, spread_join, table

K = 5
CELLS = 4
#: Vectors a pivot, and the most pivots a model may have (16,384 of 96 numbers are 6 MB).
VECTORS_A_PIVOT, MAX_PIVOTS = 80, 16384
#: A cell beyond this is split again.
LARGE_CELL = 6000
PROJECTIONS = 24
#: Windows of the virtual rehashing: half-width (in units of the unit vectors' projections) and collisions needed.
LEVELS = ((0.63, 11), (1.0, 14), (1.6, 18))
SEED = 20240101


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(model_version, paper_id, v, copy): the latest vector of each paper and model, if usable, as unit floats; equal ones have one copy.

    The latest created_at counts (a null one is oldest; at a tie the larger array); if it is null, empty, zero, of
    another length than most of its model or holds a null, NaN or infinity, the paper has no neighbours there.
    """
    rows = vectors.where(F.col("paper_id").isNotNull() & F.col("model_version").isNotNull())
    rows = rows.select("paper_id", "model_version", "created_at", F.col("embedding").cast("array<float>").alias("embedding"))
    latest = rows.groupBy("model_version", "paper_id").agg(F.max(F.struct("created_at", "embedding")).alias("m")).select("model_version", "paper_id", F.col("m.embedding").alias("e"))
    sizes = rows.where(F.size("embedding") > 0).groupBy("model_version", F.size("embedding").alias("n")).count()
    most = sizes.groupBy("model_version").agg(F.max(F.struct("count", "n")).alias("m")).select("model_version", F.col("m.n").alias("dim"))  # one row a model
    fine = latest.join(most, "model_version").where(F.size("e") == F.col("dim")).select("model_version", "paper_id", "e", "dim")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                x = own.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(own.num_rows, dim)
                with np.errstate(all="ignore"):
                    norm = np.sqrt((x * x).sum(axis=1))
                    good = np.isfinite(norm) & (norm > 0)
                    v = (x[good] / norm[good, None] + 0.0).astype(np.float32)
                at = pa.array(np.flatnonzero(good))
                copies = np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in v], np.uint64).view(np.int64)
                offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * np.int32(dim))
                yield pa.RecordBatch.from_arrays([own.column(0).take(at), own.column(1).take(at), pa.ListArray.from_arrays(offsets, pa.array(v.ravel())), pa.array(copies)], names=["model_version", "paper_id", "v", "copy"])

    return fine.mapInArrow(run, "model_version string, paper_id string, v array<float>, copy bigint")


def _nearest(v: np.ndarray, pivots: np.ndarray, r: int) -> np.ndarray:
    r = min(r, len(pivots))
    out = np.empty((len(v), r), np.int32)
    for a in range(0, len(v), 2048):
        s = v[a : a + 2048] @ pivots.T
        out[a : a + 2048] = np.argpartition(-s, r - 1, axis=1)[:, :r] if r < len(pivots) else np.arange(r)
    return out


def search_cell(v: np.ndarray, names: np.ndarray, k: int, least: float, depth: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, cosine) in one cell: up to k neighbours of at least ``least``, ties by name."""
    n = len(v)
    if n > LARGE_CELL and depth < 4:
        rng = np.random.default_rng(SEED + n + depth)
        pivots = v[rng.choice(n, n // VECTORS_A_PIVOT // 2, replace=False)]
        cells = _nearest(v, pivots, CELLS)
        flat, order = cells.ravel(), np.argsort(cells.ravel(), kind="stable")
        parts = []
        for chunk in np.split(order, np.flatnonzero(np.diff(flat[order])) + 1):
            if 1 < len(rows := chunk // cells.shape[1]) < n:
                q, o, s = search_cell(v[rows], names[rows], k, least, depth + 1)
                parts.append((rows[q], rows[o], s))
        if parts:
            q, o, s = (np.concatenate(x) for x in zip(*parts))
            return _top(q, o, s, names, k)
        depth = 4
    rng = np.random.default_rng(SEED)
    lines = rng.standard_normal((v.shape[1], PROJECTIONS)).astype(np.float32)
    h = v @ lines
    order = np.argsort(h, axis=0, kind="stable")
    arrays = np.take_along_axis(h, order, 0)  # one sorted array a line
    whole, sign_less = (np.int16, np.uint16) if n < 2**15 else (np.int32, np.uint32)
    rank = np.empty((PROJECTIONS, n), whole)
    for j in range(PROJECTIONS):
        rank[j, order[:, j]] = np.arange(n, dtype=whole)
    found_q, found_o, found_s = [], [], []
    step = max(16, 2_000_000 // n)
    for a in range(0, n, step):
        open_q = np.arange(a, min(n, a + step))
        for level, (half, need) in enumerate((*LEVELS, (np.inf, 0))):
            if need:
                count = np.zeros((len(open_q), n), np.int8)
                for j in range(PROJECTIONS):
                    x = h[open_q, j]
                    lo = np.searchsorted(arrays[:, j], x - half, "left").astype(whole)
                    width = np.searchsorted(arrays[:, j], x + half, "right").astype(whole) - lo
                    # Inside the window of this line: one unsigned comparison of ranks.
                    count += ((rank[j][None, :] - lo[:, None]).view(sign_less) < width[:, None].view(sign_less)).view(np.int8)
                hit = count >= need
            else:
                hit = np.ones((len(open_q), n), bool)
            hit[np.arange(len(open_q)), open_q] = False
            i, o = np.nonzero(hit)
            s = np.einsum("ij,ij->i", v[open_q[i]], v[o], dtype=np.float64)
            # A window of this half-width vouches for cosines of at least this much.
            vouched = max(1 - half * half / 2, -1.0) if need else -1.0
            good = s >= max(least, vouched if need else least)
            full = np.bincount(i[good], minlength=len(open_q)) >= k
            done = full | (vouched <= least)
            take = done[i] & (s >= least)
            found_q.append(open_q[i[take]])
            found_o.append(o[take])
            found_s.append(s[take])
            open_q = open_q[~done]
            if not len(open_q):
                break
    q, o, s = np.concatenate(found_q), np.concatenate(found_o), np.concatenate(found_s)
    return _top(q, o, s, names, k)


def _top(q: np.ndarray, o: np.ndarray, s: np.ndarray, names: np.ndarray, k: int):
    """The k best a query: by cosine to 6 places, then by name; a pair found twice counts once."""
    if not len(q):
        return q, o, s
    s6 = np.round(s, 6)
    place = np.empty(len(names), np.int64)
    place[np.argsort(names, kind="stable")] = np.arange(len(names))
    order = np.lexsort((place[o], -s6, q))
    q, o, s = q[order], o[order], s[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (o[1:] != o[:-1])
    q, o, s = q[new], o[new], s[new]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    at = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate([first, [len(q)]])))
    return q[at < k], o[at < k], s[at < k]


def similar_vectors(spark: SparkSession, vectors: DataFrame, k: int = K, least: float = -1.0, cells: int = CELLS) -> DataFrame:
    """(model_version, paper_id, neighbour, cosine): up to k most similar vectors of other papers of at least ``least``.

    Exact copies: all but the first k + 1 of a copy class (by paper_id) take the first k of it, whose cosine is 1.
    Every vector is indexed; measured recall is in the README.  An empty table gives no rows.
    """
    scratch = Scratch(spark, "vectors")
    units = scratch.save(unit_vectors(vectors), "units")
    # Classes of exact copies, by a hash of the vector; only their rows are ranked.
    of = ["model_version", "copy"]
    multi = scratch.save(units.groupBy(*of).agg(F.count("*").alias("n")).where("n > 1"), "classes")
    lead = units.join(multi.select(*of), of, "left_semi").withColumn("rn", F.row_number().over(W.partitionBy(*of).orderBy("paper_id"))).where(F.col("rn") <= k + 1)
    lead = scratch.save(lead.select("model_version", "paper_id", "v", "copy", "rn"), "lead")
    columns = ["model_version", "paper_id", "v"]
    alone = units.join(multi.select(*of), of, "left_anti").select(*columns)
    heads = alone.unionByName(lead.select(*columns))
    sizes = {r["model_version"]: r["n"] for r in heads.groupBy("model_version").agg(F.count("*").alias("n")).collect()}
    # The index is fitted on a bounded sample: the pivots, different vectors by smallest hash of the name.
    distinct = alone.unionByName(lead.where("rn = 1").select(*columns))
    per = {m: max(1, min(MAX_PIVOTS, n // VECTORS_A_PIVOT)) for m, n in sizes.items()}
    pivots = {}
    for m, n in per.items():
        rows = distinct.where(F.col("model_version") == m).select("v", F.xxhash64("paper_id").alias("h")).orderBy("h").limit(n).collect()
        pivots[m] = np.array([r["v"] for r in rows], np.float32)
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = np.array(batch.column(0).to_pylist(), dtype=object)
            for m in dict.fromkeys(models.tolist()):
                own = batch.filter(pa.array(models == m))
                flat = own.column(2).flatten().to_numpy(zero_copy_only=False)
                near = _nearest(flat.reshape(own.num_rows, -1), shared.value[m], cells)
                take = pa.array(np.repeat(np.arange(own.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([own.column(0).take(take), own.column(1).take(take), own.column(2).take(take), pa.array(near.ravel(), pa.int32())], names=["model_version", "paper_id", "v", "cell"])

    def search(key: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        names = np.array(tab.column("paper_id").to_pylist(), dtype=object)
        flat = tab.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        q, o, s = search_cell(flat.reshape(len(names), -1), names, k, least)
        return pa.table({"model_version": pa.array([key[0].as_py()] * len(q), pa.string()), "paper_id": pa.array(names[q], pa.string()), "neighbour": pa.array(names[o], pa.string()), "cosine": pa.array(s, pa.float64())})

    placed = heads.mapInArrow(assign, "model_version string, paper_id string, v array<float>, cell int")
    found = placed.groupBy("model_version", "cell").applyInArrow(search, "model_version string, paper_id string, neighbour string, cosine double")
    ranked = found.groupBy("model_version", "paper_id", "neighbour").agg(F.max("cosine").alias("cosine"))
    best = W.partitionBy("model_version", "paper_id").orderBy(F.desc(F.round("cosine", 6)), "neighbour")
    top = ranked.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).drop("rn")
    # Further copies: the first k of their class are as near as can be.  A class may hold a third of all rows: it is spread.
    further = units.join(multi.where(F.col("n") > k + 1).select(*of), of, "left_semi").select(*of, "paper_id").join(lead.select("model_version", "paper_id"), ["model_version", "paper_id"], "left_anti")
    heavy = [r["copy"] for r in multi.where(F.col("n") >= F.greatest(F.lit(10_000.0), F.lit(HEAVY * sum(sizes.values())))).select("copy").collect()]
    first = lead.where(F.col("rn") <= k).select(F.col("model_version").alias("m"), "copy", F.col("paper_id").alias("neighbour"))
    copies = spread_join(further, first, "copy", heavy).where(F.col("model_version") == F.col("m")).select("model_version", "paper_id", "neighbour", F.lit(1.0).alias("cosine"))
    return top.unionByName(copies)


def similar_pairs(spark: SparkSession, vectors: DataFrame, least: float = 0.8) -> DataFrame:
    """(model_version, paper_a, paper_b), smaller first: cosine of at least ``least`` and one among the k best of the other."""
    near = similar_vectors(spark, vectors, least=least)
    return near.select("model_version", F.least("paper_id", "neighbour").alias("paper_a"), F.greatest("paper_id", "neighbour").alias("paper_b")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(spark, table(spark, sf_dir, "paper_vectors"))


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar embeddings of every usable one, with their cosines."""
    return similar_vectors(spark, table(spark, sf_dir, "paper_vectors")).withColumn("cosine", F.round("cosine", 4))
