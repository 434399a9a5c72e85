"""Uniform global shuffle into shards of exact size by a hypergeometric communication matrix.

The matrix of rows that each partition sends to each shard is drawn so that its row sums are the
partition sizes and its column sums the shard sizes; each partition permutes its rows locally and deals
them by its row of the matrix; each shard permutes what it received. Every permutation of the corpus is
equally likely (up to the random generator).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.inputs import free_name
from strandline.operators.components import cut_lineage

#: Rows of a shard that are permuted together in one task, about.
CELL_ROWS = 500_000
#: Least number of such cells of a shard; a power of two, as their number is.
LEAST_CELLS = 64


def communication_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each partition sends to each shard: multivariate hypergeometric, column sums at most one apart.

    Memory and time are partitions times shards.
    """
    total = sum(sizes)
    left = np.array([total // shards + (k < total % shards) for k in range(shards)], np.int64)
    random = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((len(sizes), shards), np.int64)
    for i, n in enumerate(sizes):
        # one partition's draw without replacement from what the shards still take
        rest, open_ = n, int(left.sum())
        for k in range(shards):
            open_ -= int(left[k])
            out[i, k] = rest if not open_ else _hypergeometric(random, int(left[k]), open_, rest)
            rest -= out[i, k]
        left -= out[i]
    return out


def _hypergeometric(random: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Exact also beyond the generator's limit of 10**9, by halving the draws."""
    if good + bad <= 10**9:
        return int(random.hypergeometric(good, bad, draws))
    if draws <= 4096:
        hit = 0
        for _ in range(draws):
            take = int(random.integers(0, good + bad)) < good
            hit, good, bad = hit + take, good - take, bad - (not take)
        return hit
    first = _hypergeometric(random, good, bad, draws // 2)
    return first + _hypergeometric(random, good - first, bad - (draws // 2 - first), draws - draws // 2)


def _deal(matrix: np.ndarray, place: dict[int, int], seed: int, part_col: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        part = table.column(part_col).to_numpy()
        for p in np.unique(part):
            own = table.filter(pa.array(part == p))
            random = np.random.Generator(np.random.PCG64([seed, int(p)]))
            shard = np.repeat(np.arange(matrix.shape[1], dtype=np.int32), matrix[place[int(p)]])
            random.shuffle(shard)
            # a 63-bit key each for the shard's own permutation
            yield from own.append_column(names[0], pa.array(shard)).append_column(names[1], pa.array(random.integers(0, 1 << 62, len(own)))).to_batches()

    return run


def shuffle_into_shards(rows: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """rows with ``shard`` (0..shards-1, row counts at most one apart) and ``slot`` (gapless from 0 in each shard).

    Where rows has a column of such a name, the new one has underscores before it. rows should be narrow
    (ids, not texts, however long those are): a task holds one input partition of it. The order depends
    on the seed and on how rows is partitioned; equal and null rows are dealt like any others; an empty
    table gives an empty result.
    """
    shard, slot, part, key, cell, at, n, skip = (free_name(rows, c) for c in ("shard", "slot", "part", "key", "cell", "at", "n", "skip"))
    base = cut_lineage(rows.withColumn(part, F.spark_partition_id()))
    sizes = {r[0]: r[1] for r in base.groupBy(part).agg(F.count("*")).orderBy(part).collect()}
    matrix = communication_matrix(list(sizes.values()), shards, seed)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    dealt = base.mapInArrow(_deal(matrix, {p: i for i, p in enumerate(sizes)}, seed, part, [shard, key]), f"{kinds}, `{shard}` int, `{key}` long")
    cells = LEAST_CELLS
    while cells * CELL_ROWS < sum(sizes.values()) / shards:
        cells *= 2
    # a cell holds a range of keys, so that cells in order and rows in order by key make one uniform permutation
    dealt = cut_lineage(dealt.withColumn(cell, F.shiftright(key, 62 - cells.bit_length() + 1).cast("int")))
    before = dealt.groupBy(shard, cell).agg(F.count("*").alias(n))
    before = before.select(shard, cell, F.coalesce(F.sum(n).over(Window.partitionBy(shard).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(skip))
    placed = F.row_number().over(Window.partitionBy(shard, cell).orderBy(key, part, *[f"`{c}`" for c in rows.columns]))
    return dealt.withColumn(at, placed).join(before, [shard, cell]).select(*[f"`{c}`" for c in rows.columns], shard, (F.col(skip) + F.col(at) - 1).alias(slot))


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32): UTF-8 bytes of the text plus 1, and its unsigned CRC-32; null texts are taken as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shuffle_into_shards(document_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
