"""MinHash near-duplicate detection with odd sketches.

Documents with equal shingle sets form a class, and only one of each class goes on. Its MinHash
samples give band keys (the candidate buckets) and an odd sketch (parity bitmap) whose XOR population
count estimates the similarity and drops pairs far below the threshold; what is left is confirmed on
the full shingle sets. Buckets are joined as stars first (each member with the smallest), then the
pairs of a bucket that the confirmed links leave in different components are tested too (a spanning
forest before the rest), so that no bucket pair that can still link goes untested and a dense group of copies still costs one row a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.inputs import read_spread
from strandline.llm.shingles import mix, text_shingles
from strandline.llm.skew import HOT_KEYS, join_counted, let_go, only_ids
from strandline.operators.components import connected_components, cut_lineage

#: 36 bands of 4: a pair at 0.75 shares no band with probability (1 - 0.75**4)**36 = 1e-6.
BANDS, ROWS = 36, 4
SAMPLES = BANDS * ROWS
#: One-permutation MinHash samples (the least hash of each bin) and the parity bits that they are folded into.
BINS, SKETCH_BITS = 1 << 14, 1 << 12
#: Pairs whose XOR count lies this many standard deviations over that of the threshold are dropped.
DEVIATIONS = 5.0
#: The same for Chernoff's bound: a pair at the threshold is dropped with probability exp(-CHERNOFF) at most.
CHERNOFF = 15.0
#: Pairs with one partner in a task, members of a bucket in a block.
STAR_ROWS, BLOCK_ROWS = 2000, 1024
#: One node in so many is looked at to find band keys that many share.
SAMPLED = 64
#: Ids from here on are made here, for rows without doc_id and for further texts of one doc_id.
MADE = 1 << 62

_rng = np.random.Generator(np.random.PCG64(75))
_A = _rng.integers(1, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_ROW = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of non-empty sorted sets: band keys (n x BANDS, int64), odd sketches (n x SKETCH_BITS/64, int64), samples in each sketch."""
    cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    every = np.concatenate(sets)
    x = (every >> np.uint64(32)).astype(np.uint32)
    low = np.empty((SAMPLES, len(sets)), np.uint64)
    for j in range(SAMPLES):
        low[j] = np.minimum.reduceat((x ^ _B[j]) * _A[j], cuts)
    keys = np.empty((len(sets), BANDS), np.int64)
    for t in range(BANDS):
        keys[:, t] = mix((low[t * ROWS : (t + 1) * ROWS] * _ROW[:, None]).sum(axis=0, dtype=np.uint64) + np.uint64(t)).view(np.int64)
    return keys, *odd_sketches(sets)


def odd_sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty sorted sets: odd sketches (n x SKETCH_BITS/64, int64), samples in each sketch."""
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cell = owner * BINS + (every >> np.uint64(50)).astype(np.int64)
    least = np.concatenate([[True], cell[1:] != cell[:-1]])
    spot = owner[least] * SKETCH_BITS + (mix(every[least]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    bits = (np.bincount(spot, minlength=len(sets) * SKETCH_BITS) & 1).astype(np.uint8).reshape(len(sets), -1)
    return np.packbits(bits, axis=1).view(np.int64), np.bincount(owner[least], minlength=len(sets))


def _allowed(xor_count, samples, shingles, percent: int, m):
    """Whether an XOR count allows the threshold; samples and shingles are the two documents' sums.

    For numpy arrays (m: numpy) or columns (m: pyspark.sql.functions). How many samples differ at the
    threshold follows from the sizes, and so does the XOR count that they leave. Its deviation is that
    of the parity folding and of the draw: which shingles of the union are samples, and of how many bins;
    to it comes Bernstein's term for few steps of 2, as small sets have them.
    Where the limit reaches half of the bits, as for sets of some 25,000 shingles and more, a count
    says nothing and every pair is allowed.
    For small sets another limit is sharper. Folding never adds to the count, so a count is at most the
    shingles that one document alone has (of which the threshold allows ``apart``) and the bins in which
    such a shingle hides one that both have. These bins are seldom; Chernoff's bound says how seldom.
    """
    n, goal = SKETCH_BITS, percent / 100
    exp, sqrt, most = m.exp, m.sqrt, m.maximum if m is np else m.greatest
    load = 1 / (1 + goal) / BINS * shingles  # shingles of the union a bin
    empty = exp(-1 * load)
    union = BINS * (1 - empty)
    at = most(samples - 2 * goal * union, 0 * union)
    drawn = 4 * goal * (1 - goal) * union * (1 - (1 - empty) / load) + 4 * goal * goal * BINS * (empty - (1 + load) * empty * empty)
    kept = exp(-2 / n * at)
    folded = n / 4 * (1 - kept * kept) - at * kept * kept
    limit = n / 2 * (1 - kept) + DEVIATIONS * sqrt(most(folded + drawn * kept * kept, 0 * union)) + DEVIATIONS * DEVIATIONS / 3
    apart = shingles - 2 * m.floor((percent * shingles + 99 + percent) / (100 + percent))
    hidden = apart * (1 - exp(-0.5 / BINS * shingles)) / 2 + 1e-9
    extra = most(xor_count - apart, hidden)
    fits = extra * (1 + m.log(hidden / extra)) - hidden >= -CHERNOFF
    return ((xor_count <= limit) | (limit >= n / 2)) & fits


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, sets in text_shingles(batch.column(2)):
            size = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(size)
            keys, sketch = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), SKETCH_BITS // 64), np.int64)
            mark, samples = np.zeros((2, len(sets)), np.int64), np.zeros(len(sets), np.int64)
            if len(full):
                own = [sets[i] for i in full]
                keys[full], sketch[full], samples[full] = signatures(own)
                cuts = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                every = np.concatenate(own)
                mark[0, full] = np.add.reduceat(every, cuts).view(np.int64)
                mark[1, full] = np.add.reduceat(mix(every + np.uint64(1)), cuts).view(np.int64)
            empty = size == 0
            yield pa.record_batch(
                [batch.column(0).slice(start, len(sets)), batch.column(1).slice(start, len(sets)), pa.array(size), pa.array(mark[0], mask=empty), pa.array(mark[1], mask=empty), _lists(keys, empty), _lists(sketch, empty), pa.array(samples)],
                names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands", "sketch", "samples"],
            )


def _lists(x: np.ndarray, empty: np.ndarray) -> pa.Array:
    width = np.where(empty, 0, x.shape[1])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), pa.array(x[~empty].ravel()))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"), F.col(text_col).cast("string").alias("text"))


def document_signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, set_a, set_b, bands, sketch, samples) of every row; set_a and set_b name the shingle set (null: no words)."""
    kinds = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>, samples long"
    return _texts(docs, id_col, text_col).mapInArrow(_sign, kinds)


def _with_node(rows: DataFrame, clash: DataFrame | None) -> DataFrame:
    """rows (doc_id, text_key, ...) with ``doc``: the doc_id, but made from id and text where there is none, or for another text than the first of clash."""
    made = F.lit(MADE) + F.shiftrightunsigned(F.xxhash64("doc_id", "text_key"), 3)
    if clash is None:
        return rows.withColumn("doc", F.coalesce("doc_id", made))
    return rows.join(clash, "doc_id", "left").withColumn("doc", F.when(F.col("doc_id").isNull() | (F.col("text_key") > F.col("first_key")), made).otherwise(F.col("doc_id"))).drop("first_key")


def _xor_count(x: str, y: str) -> F.Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, against = None, None
        for batch in batches:
            stars, ids, heads = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            a, b = [], []
            for start, sets in text_shingles(batch.column(4)):
                for k, own in enumerate(sets, start):
                    if heads[k]:
                        pivot, against = stars[k], own
                        continue
                    if stars[k] != pivot:
                        raise ValueError(f"no text for document {stars[k]}")
                    both = len(own) + len(against) - len(np.union1d(own, against))
                    if 100 * both >= percent * (len(own) + len(against) - both) and both:
                        a.append(pivot)
                        b.append(ids[k])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["src", "dst"])

    return run


def confirmed_links(pairs: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (src, dst) whose full shingle sets have 100 * intersection >= percent * union; texts: (doc, text).

    Pairs are grouped by src and streamed past its set; a src with many partners is dealt over several
    groups. Only the texts of documents in pairs are shuffled, and few others that pass a filter of their ids.
    """
    fan = pairs.groupBy("src").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / STAR_ROWS).cast("int"))
    ends = join_counted(pairs, fan, ["src"], "n").select("src", F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part"), F.col("dst").alias("doc"), F.lit(False).alias("head"))
    heads = fan.select("src", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("src").alias("doc"), F.lit(True).alias("head"))
    wanted = cut_lineage(pairs.select(F.explode(F.array("src", "dst")).alias("doc")).distinct())
    rows = heads.unionByName(ends).join(only_ids(texts, wanted, "doc"), "doc").select("src", "part", "doc", "head", "text")
    return rows.repartition("src", "part").sortWithinPartitions("src", "part", F.desc("head"), "doc").mapInArrow(_confirm(percent), "src long, dst long")


def _cell_pairs(batches: Iterator[pa.RecordBatch], percent: int, spanning: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs of each cell's blocks in different components whose sizes and odd sketches allow the threshold.

    spanning: only so many of them, those with least XOR counts, that the pairs join all that all pairs would join.
    """
    names, held, now = ["src", "dst"], [], None
    far = np.iinfo(np.int64).max

    def pairs(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        doc, comp, n, samples, block = (t.column(c).to_numpy() for c in ("doc", "comp", "n", "samples", "block"))
        # unsigned: bitwise_count takes the absolute value of what is signed
        sketch = t.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(doc), -1)
        mixed = block.min() != block.max()
        a, b = [], []
        left, best, link, i = np.ones(len(doc), bool), np.full(len(doc), far), np.zeros(len(doc), np.int64), 0
        for k in range(len(doc)):
            if not spanning:
                i = k
            elif k:  # Prim: the nearest to those joined so far, or one that nothing joins
                i = np.flatnonzero(left)[best[left].argmin()]
                if 0 <= best[i] < far:
                    a.append(np.minimum(doc[i : i + 1], doc[link[i]]))
                    b.append(np.maximum(doc[i : i + 1], doc[link[i]]))
            left[i] = False
            best[left & (comp == comp[i])] = -1
            ok = np.flatnonzero(left & (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & ((block != block[i]) | (not mixed)))
            count = np.bitwise_count(sketch[ok] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            fit = _allowed(count, samples[ok] + samples[i], n[ok] + n[i], percent, np)
            ok, count = ok[fit], count[fit]
            if spanning:
                nearer = count < best[ok]
                best[ok[nearer]], link[ok[nearer]] = count[nearer], i
            else:
                a.append(np.minimum(doc[ok], doc[i]))
                b.append(np.maximum(doc[ok], doc[i]))
        return pa.record_batch([np.concatenate([*a, np.empty(0, np.int64)]), np.concatenate([*b, np.empty(0, np.int64)])], names=names)

    for batch in batches:
        if not len(batch):
            continue
        cell = np.stack([batch.column(c).to_numpy() for c in ("key", "lo", "hi")])
        cuts = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1), len(batch)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if held and now != tuple(cell[:, i]):
                yield pairs(held)
                held = []
            now = tuple(cell[:, i])
            held.append(batch.slice(i, j - i))
    if held:
        yield pairs(held)


def _cells(labelled: DataFrame, sizes: DataFrame) -> DataFrame:
    """The members (key, doc, pivot, comp) of split buckets, dealt over the cells (key, lo, hi) whose pairs can still link.

    The pivot of a bucket has been tested against each member. In a bucket of more than a block the members
    of the largest component meet only those of the others, who meet all.
    """
    rest = labelled.where("doc <> pivot").select("key", "doc", "comp")
    main = rest.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    whole = F.col("n") <= BLOCK_ROWS
    split = main.select("key", F.when(~whole, F.col("top.comp")).alias("main"), F.when(whole, 1).otherwise(blocks(F.col("n") - F.col("top.n"))).alias("others"), F.when(whole, 0).otherwise(blocks(F.col("top.n"))).alias("mains"))
    own = F.coalesce(F.col("comp") == F.col("main"), F.lit(False))
    place = F.xxhash64("doc")
    dealt = rest.join(split, "key").withColumn("block", F.when(own, F.col("others") + F.pmod(place, F.col("mains"))).otherwise(F.pmod(place, F.col("others"))).cast("int"))
    dealt = dealt.withColumn("meets", F.col("others") + F.when(own, 0).otherwise(F.col("mains"))).join(sizes, "doc")
    cells = dealt.select("key", "doc", "comp", dealt["n"], "sketch", "samples", "block", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)).alias("other"))
    return cells.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc", "comp", "n", "sketch", "samples", "block")


def _members(nodes: DataFrame) -> DataFrame:
    """(key, doc, pivot) of the buckets of two and more documents; pivot is the least doc of a bucket.

    Keys that many documents share, as a sample of nodes tells, are counted before any shuffle; the
    sample moves only where a bucket's pivot is found.
    """
    banded = nodes.select(F.explode("bands").alias("key"), "doc")
    sampled = nodes.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLED)) == 0).select(F.explode("bands").alias("key"))
    least = max(16, nodes.count() * BANDS // SAMPLED // HOT_KEYS)
    # at most the sample's rows / least keys, some HOT_KEYS
    hot = cut_lineage(sampled.groupBy("key").count().where(F.col("count") >= least).select("key"))
    ends = banded.join(F.broadcast(hot), "key").groupBy("key").agg(F.min("doc").alias("pivot"), F.max("doc").alias("last"))
    many = banded.join(F.broadcast(ends), "key")
    bucket = Window.partitionBy("key")
    few = banded.join(F.broadcast(hot), "key", "left_anti").select("key", "doc", F.min("doc").over(bucket).alias("pivot"), F.max("doc").over(bucket).alias("last"))
    return cut_lineage(few.unionByName(many).where("pivot <> last").drop("last"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key): one row per row of ``docs``; text_key is xxhash64 of the text.

    Links are pairs whose shingle sets have 100 * intersection >= percent * union (percent >= 75);
    component_id is the smallest doc_id reachable, kept says that it is the row's own. Null, empty and
    blank texts have no shingles and stay alone. Repeated rows repeat in the result. Different texts of
    one doc_id are documents of their own, of which the one with the least text_key goes by the doc_id;
    so are rows without doc_id, and a component of such rows alone has the doc_id of the one it keeps
    (maybe null). doc_ids lie below 2**62. Texts are compared whole, however long. An empty table gives no
    rows; other columns are ignored.
    """
    if percent < 75:
        raise ValueError("bands and sketch limit are set for 75 percent and more")
    signed = cut_lineage(document_signatures(docs, id_col, text_col))
    clash = cut_lineage(signed.groupBy("doc_id").agg(F.min("text_key").alias("first_key"), F.max("text_key").alias("last_key")).where("doc_id is null or first_key <> last_key").drop("last_key"))
    clash = None if clash.isEmpty() else clash
    signed = _with_node(signed, clash)
    if clash is not None:
        signed = cut_lineage(signed)
    texts = _with_node(_texts(docs, id_col, text_col), clash).select("doc", "text").where("text is not null")
    # one node a shingle set
    full = signed.where("set_a is not null")
    found = full.groupBy("set_a", "set_b").agg(F.min_by(F.struct("n_shingles", "bands", "sketch", "samples"), "doc").alias("s"), F.min("doc").alias("doc"), F.count("*").alias("n"))
    found = cut_lineage(found.select("set_a", "set_b", "n", "doc", "s.*"))
    nodes, classes = found.select("doc", "n_shingles", "bands", "sketch", "samples"), found.where("n > 1").select("set_a", "set_b", "n", F.col("doc").alias("rep"))
    members = _members(nodes)
    sizes = nodes.select("doc", F.col("n_shingles").alias("n"), "sketch", "samples")

    stars = cut_lineage(members.where("doc <> pivot").select(F.col("pivot").alias("src"), F.col("doc").alias("dst")).distinct())
    left, right = (sizes.select(F.col("doc").alias(e), F.col("n").alias(f"n_{e}"), F.col("sketch").alias(f"x_{e}"), F.col("samples").alias(f"s_{e}")) for e in ("src", "dst"))
    centres = left.join(stars.groupBy("src").agg(F.count("*").alias("links")), "src")
    # by dst first: sketches of stars are not shuffled where the centre is hot
    near = join_counted(stars.join(right, "dst"), centres, ["src"], "links").where(f"100 * least(n_src, n_dst) >= {percent} * greatest(n_src, n_dst)")
    near = near.where(_allowed(_xor_count("x_src", "x_dst"), F.col("s_src") + F.col("s_dst"), F.col("n_src") + F.col("n_dst"), percent, F))
    let_go(docs.sparkSession)
    near = cut_lineage(near.select("src", "dst").distinct())
    let_go(docs.sparkSession)
    links = cut_lineage(confirmed_links(near, texts, percent))
    comps = connected_components(links)
    let_go(docs.sparkSession)

    # first a spanning forest of what may link, so that a dense group is joined by few pairs, then every pair that is left
    for spanning in (True, False):
        labelled = members.join(comps.select(F.col("id").alias("doc"), "component"), "doc", "left").select("key", "doc", "pivot", F.coalesce("component", "doc").alias("comp"))
        cells = _cells(labelled, sizes).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "doc")
        more = cut_lineage(cells.mapInArrow(lambda batches, spanning=spanning: _cell_pairs(batches, percent, spanning), "src long, dst long").distinct())
        if more.isEmpty():
            break
        let_go(docs.sparkSession)
        links = links.unionByName(cut_lineage(confirmed_links(more, texts, percent)))
        comps = connected_components(links)
        let_go(docs.sparkSession)
    comps = comps.select(F.col("id").alias("doc"), F.col("component").alias("reached"))
    of_class = classes.join(comps.withColumnRenamed("doc", "rep"), "rep", "left").select("set_a", "set_b", "n", F.coalesce("reached", "rep").alias("of_class"))
    rows = join_counted(signed.select("doc_id", "text_key", "n_shingles", "set_a", "set_b", "doc"), of_class, ["set_a", "set_b"], "n", "left")
    out = rows.join(comps, "doc", "left").select("doc_id", "n_shingles", "text_key", "doc", F.coalesce("of_class", "reached", "doc").alias("node"))
    kept = (F.col("doc") == F.col("node")).alias("kept")
    plain = out.select("doc_id", "n_shingles", F.col("node").alias("component_id"), kept, "text_key")
    if clash is None:
        return plain
    made = signed.where(F.col("doc") >= MADE).select(F.col("doc").alias("node"), F.col("doc_id").alias("real")).distinct()
    odd = out.where(F.col("node") >= MADE).join(made, "node").select("doc_id", "n_shingles", F.col("real").alias("component_id"), kept, "text_key")
    return plain.where(F.col("component_id") < MADE).unionByName(odd)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_spread(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
