import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from strandline.llm import near_dedup
from strandline.llm.near_dedup import _allowed, _cell_pairs, _cells, near_duplicates, odd_sketches

SCHEMA = "doc_id long, text string, extra string"


def brute(rows):
    """component of each doc_id by comparing all pairs of full shingle sets."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and min(len(x), len(y)) * 100 >= 75 * max(len(x), len(y)) and 100 * (n := len(x & y)) >= 75 * (len(x) + len(y) - n):
            i, j = sorted((top(a), top(b)))
            up[j] = i
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}


def test_same_as_brute_force_on_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(docs) == want
    assert sum(not v[2] for v in want.values()) > 0


def test_chain_star_and_edges(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(10, " ".join(base)), (11, "\t".join(base).upper())]
    for k in range(1, 9):  # a chain: each one differs a little more from the first
        rows.append((20 + k, " ".join(base[k * 3 :] + [f"x{i}" for i in range(k * 3)])))
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "two one"), (7, "a b c d"), (8, "a b c d"), (9, "é " * 3), (30, "y" * 100_000 + " z " + "q " * 5000), (31, "q " * 5000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], SCHEMA)
    assert result(df) == brute(rows)


def test_empty_table_null_ids_and_repeats(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", ""), (1, "a b c d e f", ""), (None, "a b c d e f", ""), (None, None, "")], SCHEMA)
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(df).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("None", "1", False), ("None", "None", True)]


def test_different_texts_of_one_id_and_texts_without_id(spark):
    words = lambda n, k: " ".join(f"{n}{i}" for i in range(k))
    a, b, c = words("a", 50), words("b", 50), words("c", 50)
    df = spark.createDataFrame([(7, a, ""), (7, b, ""), (9, a + " end", ""), (9, b.upper() + " end", ""), (3, "x", ""), (None, c, ""), (None, c + " end", ""), (None, b + "\tend", "")], SCHEMA)
    got = near_duplicates(df).collect()
    assert len(got) == 8
    by = {}
    for r in got:
        by.setdefault(r.component_id, []).append(r)
    assert sorted((str(k), len(v), sum(r.kept for r in v)) for k, v in by.items()) == [("3", 1, 1), ("7", 5, 2), ("None", 2, 1)]


def test_third_of_all_rows_in_one_set_and_one_bucket(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(i, text) for i in range(1000, 1400)] + [(i, f"{text} tail{i}") for i in range(400)] + [(i, " ".join(f"v{i}x{j}" for j in range(20))) for i in range(2000, 2400)]
    got = result(spark.createDataFrame([(i, t, "k") for i, t in rows], SCHEMA))
    assert {i: v[1] for i, v in got.items()} == {i: 0 if i < 2000 else i for i, _ in rows}


def test_batches_of_few_words(spark):
    for rows in ([(1, "one")], [(1, "a b"), (2, "a b")], [(1, "a b c d e")]):
        assert result(spark.createDataFrame([(i, t, "k") for i, t in rows], SCHEMA).coalesce(1)) == brute(rows)


def random_pair(random, union, similarity):
    """Two sorted sets of 64-bit hashes with this union and at least this similarity."""
    x = random.integers(0, 1 << 64, union, dtype=np.uint64)
    both = int(np.ceil(similarity * union))
    cut = both + (union - both) // 2
    return np.sort(x[:cut]), np.sort(np.concatenate([x[:both], x[cut:]]))


def test_sketch_allows_true_pairs_of_every_size():
    random = np.random.default_rng(1)
    for union, times in ((100, 3000), (1000, 500), (20_000, 60), (40_000, 60), (80_000, 40), (200_000, 15), (400_000, 8)):
        for k in range(times):
            a, b = random_pair(random, union, 0.75 + 0.03 * k / times)
            sketch, samples = odd_sketches([a, b])
            count = np.bitwise_count(sketch.view(np.uint64)[0] ^ sketch.view(np.uint64)[1]).sum(dtype=np.int64)
            assert _allowed(np.array([count]), np.array([samples.sum()]), np.array([len(a) + len(b)]), 75, np)[0], (union, k)
    a, b = random_pair(random, 2000, 0.5)
    sketch, samples = odd_sketches([a, b])
    count = np.bitwise_count(sketch.view(np.uint64)[0] ^ sketch.view(np.uint64)[1]).sum(dtype=np.int64)
    assert not _allowed(np.array([count]), np.array([samples.sum()]), np.array([len(a) + len(b)]), 75, np)[0]


def test_cell_keeps_true_pairs():
    random = np.random.default_rng(2)
    sets = [s for _ in range(20) for s in random_pair(random, 600, 0.8)]
    sketch, samples = odd_sketches(sets)
    n = len(sets)
    same = {c: pa.array(np.zeros(n, np.int64)) for c in ("key", "lo", "hi", "block")}
    rows = {**same, "doc": pa.array(np.arange(n)), "comp": pa.array(np.arange(n)), "n": pa.array([len(s) for s in sets]), "sketch": pa.array(sketch.tolist(), pa.list_(pa.int64())), "samples": pa.array(samples)}
    found = {(a.as_py(), b.as_py()) for batch in _cell_pairs(iter([pa.RecordBatch.from_pydict(rows)]), 75) for a, b in zip(*batch.columns)}
    assert found == {(i, i + 1) for i in range(0, n, 2)}


def test_spanning_cell_joins_a_group_with_few_pairs():
    random = np.random.default_rng(4)
    base = random.integers(0, 1 << 64, 500, dtype=np.uint64)
    sets = [np.sort(np.concatenate([base, random.integers(0, 1 << 64, 20, dtype=np.uint64)])) for _ in range(50)] + list(random_pair(random, 600, 0.9))
    sketch, samples = odd_sketches(sets)
    n = len(sets)
    same = {c: pa.array(np.zeros(n, np.int64)) for c in ("key", "lo", "hi", "block")}
    comp = np.where(np.arange(n) < 10, 0, np.arange(n))
    rows = {**same, "doc": pa.array(np.arange(n)), "comp": pa.array(comp), "n": pa.array([len(s) for s in sets]), "sketch": pa.array(sketch.tolist(), pa.list_(pa.int64())), "samples": pa.array(samples)}
    found = [(a.as_py(), b.as_py()) for batch in _cell_pairs(iter([pa.RecordBatch.from_pydict(rows)]), 75, True) for a, b in zip(*batch.columns)]
    assert len(found) == 41 and (50, 51) in found and {x for pair in found for x in pair} >= set(range(10, n))


def test_largest_component_meets_only_the_others(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 10)
    labelled = spark.createDataFrame([(7, d, 0, 1 if d < 200 else d) for d in range(203)] + [(8, d, 0, d) for d in range(5)] + [(9, d, 0, 0) for d in range(5)], "key long, doc long, pivot long, comp long")
    sizes = spark.createDataFrame([(d, 9, [0], 9) for d in range(203)], "doc long, n long, sketch array<long>, samples long")
    cells = [(r.key, r.lo, r.hi, r.doc, r.comp) for r in _cells(labelled, sizes).collect()]
    assert len(cells) <= 199 + 3 * 21 + 4
    at = {}
    for key, lo, hi, doc, _ in cells:
        at.setdefault((key, doc), set()).add((lo, hi))
    for a, b in combinations(range(1, 203), 2):
        assert b < 200 or at[7, a] & at[7, b]
    assert all(at[8, a] & at[8, b] for a, b in combinations(range(1, 5), 2)) and not any(key == 9 for key, _ in at)


def test_small_blocks_change_nothing(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 2)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
