"""Approximate nearest neighbours by collision-counting hashing.

Each block of rows keeps one sorted array a projection. A query's window around its own projected value
widens level by level (virtual rehashing: no table is rebuilt); rows that lie in the windows of enough
projections are verified with the exact measure. A level's window and threshold are set so that a row
at the level's distance collides often enough with high probability; the search of a block ends at the
level that reaches the distance of the query's k-th best so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.components import cut_lineage

#: Projections, first level's distance (of unit vectors), growth of a level.
PROJECTIONS, FIRST, GROWTH = 64, 0.25, 2.0
#: A window reaches so many deviations of the projected distance; the threshold lies SLACK deviations under the expected collisions.
REACH, SLACK = 1.55, 1.0
#: Rows of a block (below 65,536, as ranks have 16 bits); rows of a group of blocks, from least to most, and groups before groups grow.
BLOCK_ROWS, LEAST_GROUP, MOST_GROUP, GROUPS = 32_768, 8192, 131_072, 64
#: Bytes of a group in a task, about: its vectors twice, as they are gathered, and its sorted arrays.
GROUP_BYTES = 320 << 20
#: The sample that gives each query its first bound: one row in so many, at most so many rows and bytes.
SAMPLE_SHARE, SAMPLE_ROWS, SAMPLE_BYTES = 16, 4096, 16 << 20
#: Queries of a slice that passes the blocks of a group together.
SLICE = 512


def projections(dim: int, count: int, seed: int = 11) -> np.ndarray:
    """dim x count, in groups of orthonormal directions."""
    random = np.random.Generator(np.random.PCG64(seed))
    groups = [np.linalg.qr(random.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.concatenate(groups, axis=1)[:, :count]


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has dim components, none null or non-finite and not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Usable vectors as float64 rows; such as would overflow or vanish when squared are scaled by a power of two, which no cosine notices."""
    x = np.array(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    most = np.abs(x).max(axis=1, initial=0)
    odd = (most > 1e100) | (most < 1e-100)
    x[odd] = np.ldexp(x[odd], -np.frexp(most[odd])[1][:, None])
    return x


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def cosine(rows: np.ndarray, lengths: np.ndarray, query: np.ndarray, length: float) -> np.ndarray:
    """Row by row and in one order of summing, so that equal vectors get equal scores wherever they are."""
    return (rows * query).sum(axis=1) / (lengths * length)


def nearest_of(ids: np.ndarray, x: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of each query's k nearest in the sample of different ids, nearest first."""
    lengths, own = _length(sample), _length(x)
    rough, out = (x / own[:, None]) @ (sample / lengths[:, None]).T, []
    rough[sample_ids[None, :] == ids[:, None]] = -np.inf
    for i in range(len(ids)):
        least = np.partition(rough[i], -k)[-k] if len(sample) > k else -np.inf
        near = np.flatnonzero((rough[i] >= least - 1e-9) & (rough[i] > -np.inf))
        exact = cosine(sample[near], lengths[near], x[i], own[i])
        best = np.lexsort((sample_ids[near], -exact))[:k]
        out.append((sample_ids[near[best]], exact[best]))
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of different ids, best first."""
    order = np.lexsort((ids, -scores))
    first = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
    return order[first]


class Block:
    """Sorted projections of a block of rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, axes: np.ndarray):
        self.ids, self.x, self.lengths = ids, x, _length(x)
        values = (x / self.lengths[:, None]) @ axes
        order = np.argsort(values, axis=0)
        self.sorted = np.take_along_axis(values, order, axis=0).T.copy()
        self.rank = np.empty((axes.shape[1], len(ids)), np.uint16)
        np.put_along_axis(self.rank, order.T, np.arange(len(ids), dtype=np.uint16)[None, :], axis=1)
        self.order = order.T.astype(np.int32)

    def windows(self, at: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last place (queries x projections) of the window of half width around each query's value."""
        ends = [(s.searchsorted(at[:, j] - half, "left"), s.searchsorted(at[:, j] + half, "right")) for j, s in enumerate(self.sorted)]
        return tuple(np.array([e[i] for e in ends]).T for i in range(2))

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many projections each row lies in the window."""
        if (high - low).sum() * 16 < self.rank.size:
            return np.bincount(np.concatenate([o[i:j] for o, i, j in zip(self.order, low, high, strict=True)]), minlength=len(self.ids))
        # wide windows: rank - low < high - low, unsigned, says the same of all rows at once
        inside = (self.rank - low.astype(np.uint16)[:, None]) <= (high - low - 1).astype(np.uint16)[:, None]
        inside[high == low] = False
        return inside.view(np.uint8).sum(axis=0, dtype=np.uint8 if len(low) < 256 else np.int32)

    def search(self, query_ids: np.ndarray, x: np.ndarray, lengths: np.ndarray, at: np.ndarray, score: np.ndarray, bound_id: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of at most k rows for each query, none behind the query's bound (score, bound_id)."""
        dim, m = self.x.shape[1], at.shape[1]
        reach = math.erf(REACH / math.sqrt(2))
        need = math.floor(m * reach - SLACK * math.sqrt(m * reach * (1 - reach)))
        last = np.where(score > -1, np.sqrt(np.maximum(0.0, 2 - 2 * np.maximum(score, -1))), 2.0)
        out = [(np.empty(0, np.int64), np.empty(0))] * len(at)
        active, level = np.arange(len(at)), FIRST
        while len(active):
            reached = np.minimum(level, last[active])
            low, high = self.windows(at[active], REACH * reached / math.sqrt(dim) + 1e-7)
            more = []
            for n, i in enumerate(active):
                if reached[n] < 2:
                    found = np.flatnonzero(self.collisions(low[n], high[n]) >= need)
                else:
                    found = np.arange(len(self.ids))
                near = cosine(self.x[found], self.lengths[found], x[i], lengths[i])
                own = self.ids[found]
                ahead = ((near > score[i]) | ((near == score[i]) & (own <= bound_id[i]))) & (own != query_ids[i])
                own, near = own[ahead], near[ahead]
                best = _best(own, near, k)
                out[i] = own[best], near[best]
                if reached[n] < last[i] and (len(best) < k or 2 - 2 * near[best[-1]] > level * level):
                    more.append(i)
            active, level = np.array(more, np.int64), level * GROWTH
        return out


def _first_bounds(dim: int, k: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample_ids, sample = shared.value
        pair = pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            for start in range(0, len(batch), SLICE):
                part = batch.slice(start, SLICE)
                known = nearest_of(part.column(0).to_numpy(), matrix(part.column(1), dim), sample_ids, sample, k)
                full = [len(i) == k for i, _ in known]
                score = [float(s[-1]) if f else None for f, (_, s) in zip(full, known, strict=True)]
                bound = [int(i[-1]) if f else None for f, (i, _) in zip(full, known, strict=True)]
                rows = [[{"vec_id": int(v), "score": float(c)} for v, c in zip(i, s, strict=True)] for i, s in known]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array(bound, pa.int64()), pa.array(rows, pa.list_(pair))], names=["id", "v", "score", "bound", "known"])

    return run


def _search_groups(dim: int, k: int):
    """Over rows by group, vectors before queries: each group's sorted arrays are built once, and its queries pass them in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = projections(dim, PROJECTIONS)
        now, held, blocks = None, [], []

        def answer(part: pa.RecordBatch) -> pa.RecordBatch:
            ids, x = part.column("id").to_numpy(), matrix(part.column("v"), dim)
            score = part.column("score").to_numpy(zero_copy_only=False).astype(np.float64)
            bound = pc.fill_null(part.column("bound"), np.iinfo(np.int64).max).to_numpy().copy()
            score[np.isnan(score)] = -np.inf
            lengths = _length(x)
            at = (x / lengths[:, None]) @ axes
            found = [(np.empty(0, np.int64), np.empty(0))] * len(ids)
            for block in blocks:
                for i, (own, near) in enumerate(block.search(ids, x, lengths, at, score, bound, k)):
                    if len(own):
                        own, near = np.concatenate([found[i][0], own]), np.concatenate([found[i][1], near])
                        best = _best(own, near, k)
                        found[i] = own[best], near[best]
                        if len(best) == k:  # the next block need not look farther
                            score[i], bound[i] = found[i][1][-1], found[i][0][-1]
            return pa.record_batch([np.repeat(ids, [len(f[0]) for f in found]), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            group, kind = (batch.column(c).to_numpy() for c in ("group", "kind"))
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]) | (kind[1:] != kind[:-1])) + 1), len(batch)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if group[i] != now:
                    now, held, blocks = group[i], [], []
                part = batch.slice(i, j - i)
                if not kind[i]:
                    held.append((part.column("id").to_numpy(), matrix(part.column("v"), dim)))
                    continue
                if held:
                    ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    blocks, held = [Block(ids[b : b + BLOCK_ROWS], x[b : b + BLOCK_ROWS], axes) for b in range(0, len(ids), BLOCK_ROWS)], []
                for start in range(0, len(part), SLICE):
                    yield answer(part.slice(start, SLICE))

    return run


def group_rows(n: int, dim: int) -> int:
    """Rows of a group: a share of all between LEAST_GROUP and MOST_GROUP, and at most as many as GROUP_BYTES hold."""
    return max(1, min(MOST_GROUP, max(LEAST_GROUP, n // GROUPS), GROUP_BYTES // (16 * dim + 14 * PROJECTIONS)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k nearest found in vectors, largest cosine first, ties to the smaller id.

    queries has the columns of vectors; a query's own id is no candidate. Rows with a null id, a vector
    that is null, zero, of another than the commonest length, or with null or non-finite components take
    no part. With fewer candidates all are returned. An id is returned once for a query, with its best
    score, whether its rows repeat or differ; queries of one id are one query, likewise. An empty table
    gives no rows; other columns are ignored.

    Rows are dealt at random over groups of blocks. The queries, each with the bound that the sample
    gives, go to all groups, so the shuffle carries queries times groups; a group's sorted arrays are
    built once. Only the sample passes the driver.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = pick(vectors).where("size(v) > 0 and id is not null").groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return empty
    dim, n = common["dim"], common["count"]
    rows, asked = (pick(df).where(F.col("id").isNotNull() & usable(F.col("v"), dim)) for df in (vectors, queries))
    size = max(1, min(SAMPLE_ROWS, n // SAMPLE_SHARE, SAMPLE_BYTES // (8 * dim)))
    got = rows.orderBy(F.xxhash64("id"), "id").limit(size).toArrow().combine_chunks()
    if not len(got):
        return empty
    sample_ids, first = np.unique(got.column("id").to_numpy(), return_index=True)
    shared = spark.sparkContext.broadcast((sample_ids, matrix(got.column("v").combine_chunks(), dim)[first]))
    bounded = cut_lineage(asked.mapInArrow(_first_bounds(dim, k, shared), "id long, v array<double>, score double, bound long, known array<struct<vec_id:bigint,score:double>>"))

    groups = -(-n // group_rows(n, dim))
    dealt = rows.select((F.rand(29) * groups).cast("int").alias("group"), F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("bound"))
    sent = bounded.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), "id", "v", "score", "bound")
    both = dealt.unionByName(sent).repartitionById(groups, F.col("group")).sortWithinPartitions("group", "kind")
    found = both.mapInArrow(_search_groups(dim, k), "query_id long, vec_id long, score double")
    # the sample's own k nearest are candidates too: the row at the bound may collide too seldom to be found
    known = bounded.select(F.col("id").alias("query_id"), F.inline("known"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    merged = found.unionByName(known).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", best).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
