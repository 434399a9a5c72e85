import zlib
from collections import Counter

import numpy as np

from strandline.llm.sharding import _hypergeometric, communication_matrix, document_sizes, op6_sharding, shuffle_into_shards


def test_matrix_sums_and_law():
    sizes = [7, 0, 100, 3, 41]
    seen = []
    for seed in range(2000):
        m = communication_matrix(sizes, 4, seed)
        assert m.sum(axis=1).tolist() == sizes and m.sum(axis=0).tolist() == [38, 38, 38, 37] and (m >= 0).all()
        seen.append(m[2, 1])
    # hypergeometric: 100 of 151 rows, 38 of them for shard 1
    assert abs(np.mean(seen) - 100 * 38 / 151) < 0.3 and abs(np.var(seen) - 100 * 38 / 151 * (113 / 151) * (51 / 150)) < 0.8


def test_large_draws_are_exact():
    random = np.random.Generator(np.random.PCG64(3))
    x = [_hypergeometric(random, 3 * 10**9, 10**9, 20_000) for _ in range(60)]
    assert abs(np.mean(x) - 15_000) < 60 and all(0 <= v <= 20_000 for v in x)


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op6_sharding(spark, sf_dir).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(n))


def test_uniform_and_edges(spark):
    rows = spark.createDataFrame([(i,) for i in range(40)], "doc_id long").repartition(3)
    places = np.zeros((40, 4))
    for seed in range(30):
        for r in shuffle_into_shards(rows, 4, seed).collect():
            places[r.doc_id, r.shard] += 1
    assert ((places - 7.5) ** 2 / 7.5).sum() < 190  # chi square, 120 degrees of freedom
    df = spark.createDataFrame([(1, None, 2), (None, "é", 2), (1, None, 2), (4, "", 2)], "doc_id long, text string, size int")
    got = shuffle_into_shards(document_sizes(df), 8).collect()
    assert sorted((r.size, r.slot) for r in got) == [(1, 0), (1, 0), (1, 0), (3, 0)]
    assert shuffle_into_shards(document_sizes(df.limit(0))).count() == 0
    names = df.selectExpr("doc_id as Key", "text as shard", "size as at", "size as part", "size as cell")
    clash = shuffle_into_shards(names, 2)
    assert clash.columns == ["Key", "shard", "at", "part", "cell", "_shard", "slot"]
    assert sorted((r.shard or "", r.at) for r in clash.collect()) == sorted((r.text or "", r["size"]) for r in df.collect())
