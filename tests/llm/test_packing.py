import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from strandline.llm.packing import _place, best_fit_pack, best_fit_runs

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, capacity):
    """Remaining room of each bin by best fit decreasing, one piece at a time over all bins."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


def test_runs_equal_plain_best_fit():
    rnd = random.Random(5)
    for _ in range(200):
        capacity = rnd.choice([1, 2, 7, 16, 31, 64])
        lengths = [min(capacity, int(rnd.paretovariate(0.7))) if rnd.random() < 0.8 else capacity // 2 or 1 for _ in range(rnd.randrange(0, 120))]
        runs = np.array(sorted(best_fit_runs(Counter(lengths), capacity)) or np.empty((0, 5)), np.int64)
        bins = defaultdict(list)
        for n, c in Counter(lengths).items():
            seq, off = _place(np.full(c, n, np.int64), np.arange(c), runs)
            for s, o in zip(seq, off):
                bins[s].append((o, n))
        for got in bins.values():
            at = 0
            for o, n in sorted(got):
                assert o == at
                at += n
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in b) for b in bins.values()) == plain_best_fit(lengths, capacity)


def check(rows, texts, capacity=4096):
    tok = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(-(-len(ids) // capacity)))
        for r in got:
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * capacity and len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for cells in by_seq.values():
        at = 0
        for o, n in sorted(cells):
            assert o == at
            at += n
        assert at <= capacity
    lengths = [n for cells in by_seq.values() for _, n in cells]
    assert len(by_seq) == len(plain_best_fit(lengths, capacity))


def test_pieces_and_sequences(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(best_fit_pack(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_odd_texts(spark):
    texts = {1: None, 2: "", 3: " \t\n", 4: "a\x1cb\x1f c\x85d\xa0e f", 5: "it's <|endoftext|>x <|startoftext|>", 6: "ΟΔΟΣ É é ́x 漢字😀 1234", 7: "word " * 9000, 8: "x" * 20_000, 9: "a b", 10: "a b"}
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in texts.items()], "doc_id long, text string, length int, salt int")
    check(best_fit_pack(df, PATH).collect(), texts)
    assert best_fit_pack(df.limit(0), PATH).count() == 0


def test_words_remembered_have_a_bound(monkeypatch):
    from strandline.llm import packing

    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 20_000)
    known, rnd = packing._WordIds(PATH), random.Random(4)
    for _ in range(3000):
        w = "".join(rnd.choice("abcde1") for _ in range(rnd.choice([5, 9, 30, 49, 400])))
        assert known[w] == known._whole(w)
        assert all(len(x) <= packing.LONGEST_REMEMBERED for x in (*known, *known.before))
        assert sum(2 * len(k) + len(v) + packing.ENTRY_BYTES for k, v in known.items()) <= 20_000


def test_parts_give_the_tokenizers_ids():
    from strandline.llm.packing import _WordIds

    known, rnd = _WordIds(PATH), random.Random(9)
    assert known.plain
    alphabet = "abZé'ÿß×÷%*.,|<>_-19İŒœKſªº²" + "́"
    for _ in range(3000):
        w = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 9)))
        assert known[w] == known._whole(w), w
