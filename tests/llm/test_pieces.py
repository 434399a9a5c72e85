import random
import zlib

import public_tokenizers
import sentencepiece

from strandline.llm.pieces import Pieces, decode_pieces, encode_pieces, op8_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_ids_of_random_texts_equal_the_librarys():
    ours, theirs, rnd = Pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(1)
    bits = ["a", "b", "th", " ", "   ", "\n", "é", "漢", "😀", "▁", "\0", "ing", "<0x0A>", "<s>", "the", "N", "1", ".", "***", "://"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, ours.encode(texts)):
        assert ids.tolist() == theirs.encode(text), text


def test_long_unspaced_texts_are_not_remembered(monkeypatch):
    from strandline.llm import pieces

    monkeypatch.setattr(pieces, "REMEMBERED_BYTES", 20_000)
    ours, theirs, rnd = Pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(6)
    for _ in range(30):
        texts = ["".join(rnd.choice("etaoin漢字shrdlu") for _ in range(rnd.choice([10, 60, 3000]))) + rnd.choice(["", " and so on"]) for _ in range(20)]
        assert [i.tolist() for i in ours.encode(texts)] == [theirs.encode(t) for t in texts]
        assert all(len(w) <= pieces.LONGEST_REMEMBERED for w in (*ours.words, *ours.parts))
        # the bound, and what one batch of 60,000 characters adds
        assert ours.held_words < 600_000 and ours.held_parts < 600_000


def test_table_and_round_trip(spark, sf_dir):
    theirs = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == theirs.encode(texts[r.doc_id]) and r.n_ids == len(r.ids)
        assert r.round_trip and r.decoded_crc32 == zlib.crc32(texts[r.doc_id].encode())


def test_edges(spark, monkeypatch):
    from strandline.llm import pieces

    monkeypatch.setattr(pieces, "PART_BYTES", 10)
    texts = [(1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "x" * 60_000), (6, " lead  two\ttab "), (None, "q"), (6, " lead  two\ttab ")]
    df = spark.createDataFrame([(*t, "c") for t in texts], "doc_id long, text string, ids string")
    encoded = encode_pieces(df, PATH)
    got = sorted((str(r.doc_id), r.text) for r in decode_pieces(encoded, PATH).collect())
    assert got == sorted((str(i), (t or "").replace("▁", " ")) for i, t in texts)
    assert encode_pieces(df.limit(0), PATH).count() == 0
    assert decode_pieces(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first().text is None
