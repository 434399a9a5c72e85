import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from strandline.llm.near_dedup import near_duplicates
from strandline.llm.secrets import scan_secrets
from strandline.llm.toxicity import held_out, learn_lexicon, score_toxicity


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = "0123456789abcdef0123456789abcdef"
    text = " ".join(f"plain{i} word" for i in range(60))
    extra = [(90_001, f"{text} token = \"{key}\" end", "en", "own", 1), (90_002, f"{text} token = \"{key}\" end now", "en", "own", 1), (None, "loose row", "en", "x", 9), (90_003, None, "en", "x", None), (90_004, "", "en", "x", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    clean = cp.drop_toxic(spark, docs, sf_dir)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    single = cp.drop_near_duplicates(spark, clean, sf_dir).cache()
    ids = {r.doc_id for r in single.collect()}
    assert 90_001 in ids and 90_002 not in ids and {None, 90_003, 90_004} <= ids and single.count() == len(ids)
    safe = {r.doc_id: r for r in cp.mask_secrets(spark, single, sf_dir).collect()}
    assert set(safe) == ids and key not in safe[90_001].text and safe[90_001].text.endswith("[SECRET] end") is False
    assert "[SECRET]" in safe[90_001].text and safe[90_001].n_chars == len(safe[90_001].text)
    before = {r.doc_id: r for r in single.collect()}
    assert all(safe[i] == before[i] for i in ids if i is None or "[SECRET]" not in (safe[i].text or ""))


def test_no_text_is_lost(spark):
    words = lambda n: " ".join(f"{n}{i}" for i in range(40))
    rows = [(7, words("a"), 1), (7, words("b"), 2), (7, words("b"), 2), (8, words("a") + " end", 3), (None, words("c"), 4), (None, words("c") + " end", 5), (None, words("d"), 6), (9, None, 7), (9, None, 7), (9, "", 8), (10, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept int")
    got = sorted(cp.drop_near_duplicates(spark, docs, "").collect(), key=lambda r: r._kept)
    assert [r._kept for r in got if r._kept not in (1, 3, 4, 5)] == [2, 6, 7, 8, 8]
    # of each pair of copies one stays, with its own columns
    assert len([r for r in got if r._kept in (1, 3)]) == 1 and len([r for r in got if r._kept in (4, 5)]) == 1
    assert all((r.doc_id, r.text, r._kept) in rows for r in got)


def test_stages_on_odd_tables(spark, sf_dir):
    names = ["_doc", "_text", "_without", "_kept", "_before", "_gone", "_key", "key", "live", "kept", "id", "found", "component_id"]
    docs = spark.createDataFrame([(1, "token=abcdefgh1x " + "word " * 20_000, "s"), (2, None, "s"), (3, "", "s"), (3, "", "s"), (4, "a b c", None)], "doc_id long, text string, source string")
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(i))
    for table, left in ((docs, (5, 4, 5)), (docs.limit(0), (0, 0, 0))):
        for stage, n in zip((cp.drop_toxic, cp.drop_near_duplicates, cp.mask_secrets), left):
            got = stage(spark, table, sf_dir)
            assert got.columns == docs.columns and got.count() == n
        packed = cp.pack(spark, table, sf_dir)
        assert packed.where("piece = 0").count() == left[0]
    assert cp.mask_secrets(spark, docs, sf_dir).where("doc_id = 1").first().text.startswith("[SECRET] word")


def test_run_against_each_operator(spark, sf_dir):
    """run() is the operators applied in turn, each to all that its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, learn_lexicon(docs, labels.where(~held_out())))
    clean = docs.join(scored.where("predicted = 0").select("doc_id"), "doc_id")
    single = clean.join(near_duplicates(clean).where("kept").select("doc_id"), "doc_id")
    texts = {r.doc_id: r.text for r in single.collect()}
    for r in scan_secrets(single).collect():
        spans = [(f.start, f.stop) for f in r.found if f.live]
        out, at, text = "", 0, texts[r.doc_id]
        for a, b in spans:
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        texts[r.doc_id] = out + text[at:] if text else text
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, text in texts.items():
        ids = tokens.encode(text or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[i, k] = (a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()))
    rows = cp.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)


def test_run(spark, sf_dir):
    rows = cp.run(spark, sf_dir).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert 3 < len(cp.STAGES) < 6
