import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from strandline.llm import runs
from strandline.llm.runs import PRIME, ROOT, collapse_runs, op12_periodic_runs, runs_of, transform


def brute(words, least=24, repeats=3):
    """Every period tried at every place."""
    found, n = [], len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q) and not any((i, j + q) == (s, s + m) for s, m, _ in found):
                found.append((i, j + q - i, q))
            i = j
    return sorted(found)


@pytest.mark.parametrize("n", [8, 64, 128, 256, 4096, 32768])
def test_transform(n):
    x = np.random.default_rng(n).integers(0, PRIME, (2, n)).astype(float)
    w = pow(ROOT, (PRIME - 1) // n, PRIME)
    got = transform(x)
    for k in {0, 1, 2, n // 2 + 1, n - 1}:
        power, total = [pow(w, k * j % n, PRIME) for j in range(n)], 0
        total = sum(int(a) * b for a, b in zip(x[1], power)) % PRIME
        assert int(got[1, k]) % PRIME == total


def periodic(r, n, alphabet):
    out = []
    while len(out) < n:
        q = r.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 60, 100])
        block = [r.choice(alphabet) for _ in range(q)]
        out += [block[i % q] for i in range(r.choice([10, 23, 24, 25, 3 * q - 1, 3 * q, 3 * q + 1, 5 * q + 2]))]
        out += [r.choice(alphabet) for _ in range(r.choice([0, 1, 5, 40]))]
    return out[:n]


def test_against_brute_force():
    r = random.Random(3)
    texts = [periodic(r, r.choice([0, 5, 23, 24, 25, 100, 400, 900]), [b"a", b"b", b"c"][: r.choice([1, 2, 3])] if r.random() < 0.5 else [b"%d" % i for i in range(50)]) for _ in range(300)]
    assert runs_of(texts) == [brute(t) for t in texts]
    assert any(len(brute(t)) > 3 for t in texts)


def test_fibonacci_words_and_long_uniform_texts():
    a, b = [b"x"], [b"x", b"y"]
    while len(b) < 3000:
        a, b = b, b + a
    assert runs_of([b]) == [brute(b)]
    assert runs_of([[b"w"] * 200_000]) == [[(0, 200_000, 1)]]
    r = random.Random(4)
    block = [b"%d" % r.randrange(10**6) for _ in range(20_011)]
    assert runs_of([[b"z"] + block * 3 + [b"y"]]) == [[(1, 60_033, 20_011)]]


def test_periods_beyond_the_last_scale(monkeypatch):
    monkeypatch.setattr(runs, "MOST_BLOCK", 16)
    r = random.Random(5)
    texts = [periodic(r, 1200, [b"%d" % i for i in range(9)]) for _ in range(40)]
    assert runs_of(texts) == [brute(t) for t in texts]


def test_collisions_of_residues_are_no_runs(monkeypatch):
    # with a tiny alphabet of residues nearly all sums vanish; words decide
    monkeypatch.setattr(runs, "copies", lambda values, blocks, size, gap: (np.repeat(blocks * size, size), np.tile(np.arange(size) + max(1, gap * size), len(blocks))))
    text = [b"%d" % i for i in range(200)] + [b"a", b"b"] * 20
    assert runs_of([text]) == [[(200, 40, 2)]]


def test_odd_tables(spark):
    long = " ".join(["la"] * 30)
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n ", "x"), (None, long, None), (4, long, "x"), (4, long, "x"), (5, "no break  here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in collapse_runs(df).collect())
    assert got == [(0, [(0, 30, 1)], "la"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 30, 1)], "la"), (4, [(0, 30, 1)], "la"), (5, [], "no break  here")]
    assert collapse_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        collapse_runs(df, least=10)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = None
    for s, m, q in found:
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(kept))


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in op12_periodic_runs(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    short = [d for d, t in texts.items() if len(t or "") < 8000]
    assert len(short) > 100 and sum(got[d][0] > 0 for d in short) > 5
    for d in short:
        assert got[d] == expected(d, texts[d])
