import numpy as np

from strandline.llm import ann
from strandline.llm.ann import Block, nearest, op3_nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(ids, x, queries, k=5):
    out = {}
    n = np.sqrt((x * x).sum(1))
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        s = (x * x[i]).sum(1) / (n * n[i])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_scores(spark):
    d = "/root/testdata/sf0.1"
    got = by_query(op3_nearest_neighbours(spark, d))
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want = brute(ids, x, [i for i in ids if i % 50 == 0])
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    exact = dict(zip(ids.tolist(), x))
    for q, found in got.items():
        for v, s in found:
            assert abs(s - exact[q] @ exact[v] / np.linalg.norm(exact[q]) / np.linalg.norm(exact[v])) < 1e-12
        assert found == sorted(found, key=lambda t: (-t[1], t[0]))
    hit = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 5 * len(want)


def test_recall_over_several_groups_and_a_small_sample(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_GROUP", 700)
    monkeypatch.setattr(ann, "GROUPS", 4)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 64)
    random = np.random.default_rng(6)
    centres = random.standard_normal((40, 64))
    x = centres[random.integers(0, 40, 5000)] + random.standard_normal((5000, 64)) * 0.4
    x = np.concatenate([x, random.standard_normal((1000, 64))])
    df = spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], "vec_id long, embedding array<double>, rank int")
    got = by_query(nearest(df, df.where("vec_id % 50 = 0")))
    want = brute(np.arange(6000), x, range(0, 6000, 50))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_repeated_ids_and_extreme_lengths(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1e-300, 1e-300]), (3, [3e200, 3e200]), (4, [1.0, 1.1]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (50, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_query(nearest(df, df.where("vec_id = 50"), k=4))[50]
    # vec_id 1 once, with the better of its vectors; 50 is the query, whichever of its vectors is nearer
    assert [v for v, _ in got] == [2, 3, 4, 1]
    assert np.allclose([s for _, s in got], [1, 1, 2.1 / np.sqrt(2 * 2.21), np.sqrt(0.5)])


def test_ties_bad_rows_and_few(spark):
    same = [0.1, 0.2, -0.3]
    rows = [(i, same, 0) for i in range(60, 0, -1)] + [(100, [1.0, 0.0, 0.0], 0), (150, None, 0), (200, [0.0, 0.0, 0.0], 0), (250, [1.0, None, 0.0], 0), (300, [float("nan"), 0.0, 1.0], 0), (350, [1.0, 1.0], 0), (None, same, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = by_query(nearest(df, df.where("vec_id % 50 = 0")))
    assert set(got) == {50, 100}
    assert [v for v, _ in got[50]] == [1, 2, 3, 4, 5] and [v for v, _ in got[100]] == [1, 2, 3, 4, 5]
    few = df.where("vec_id in (50, 51, 100, 200)")
    assert [v for v, _ in by_query(nearest(few, few.where("vec_id = 50")))[50]] == [51, 100]
    assert nearest(df.limit(0), df.limit(0)).count() == 0 and nearest(df, df.limit(0)).count() == 0


def test_the_samples_nearest_are_candidates(spark, monkeypatch):
    # no row collides often enough, and the sample is large
    monkeypatch.setattr(Block, "collisions", lambda self, low, high: np.zeros(len(self.ids), np.int64))
    monkeypatch.setattr(ann, "SAMPLE_SHARE", 1)
    random = np.random.default_rng(5)
    x = random.standard_normal((300, 64)) * 0.3 + 1
    df = spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], "vec_id long, embedding array<double>, rank int").coalesce(1)
    got = by_query(nearest(df, df.where("vec_id % 50 = 0")))
    want = brute(np.arange(300), x, range(0, 300, 50))
    assert {q: [v for v, _ in f] for q, f in got.items()} == {q: [v for v, _ in f] for q, f in want.items()}


def test_groups_are_bounded_by_bytes(spark, monkeypatch):
    for dim in (8, 64, 1024, 100_000):
        rows = ann.group_rows(10**9, dim)
        assert 1 <= rows <= ann.MOST_GROUP and rows * 16 * dim <= ann.GROUP_BYTES
    assert ann.group_rows(10**9, 64) == ann.MOST_GROUP
    # 1024 dimensions, some groups of few rows
    monkeypatch.setattr(ann, "GROUP_BYTES", 100 * (16 * 1024 + 14 * ann.PROJECTIONS))
    x = np.random.default_rng(8).standard_normal((450, 1024)) + 0.5
    assert -(-450 // ann.group_rows(450, 1024)) == 5
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = by_query(nearest(df, df.where("vec_id % 50 = 0"))), brute(np.arange(450), x, range(0, 450, 50))
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
