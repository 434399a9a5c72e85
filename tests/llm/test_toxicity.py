import math
import random
import re
import zlib

from strandline.llm import toxicity
from strandline.llm.toxicity import Lexicon, fold, held_out, keep_clean, learn_lexicon, op2_toxicity, score_toxicity

WORDS = ["grobnik", "slurbag"]


def corpus(spark):
    docs, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        filler = " ".join(f"w{chr(97 + (i * k) % 26)}{chr(97 + k)}" for k in range(30))
        text = f"{filler} you {WORDS[i % 8 // 4]} {filler[:30]} {WORDS[0]}" if bad else f"{filler} the slurbag award {filler[:20]}" if i % 16 == 1 else filler
        docs.append((i, text, "x", 0.5))
        labels.append((i, int(bad)))
    docs += [(1000, None, "x", 0.0), (1001, "", "x", 0.0), (1002, "GR0BN1K grоbnik " + "word " * 20, "x", 0.0), (1003, "word " * 50_000, "x", 0.0), (1004, "slurbag award", "x", 0.0), (1004, "slurbag award", "x", 0.0), (None, "w", "x", 0.0)]
    return spark.createDataFrame(docs, "doc_id long, text string, word string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_scores_and_exceptions(spark):
    docs, labels = corpus(spark)
    lexicon = learn_lexicon(docs, labels)
    assert "slurbag award" in lexicon.exceptions
    rows = score_toxicity(docs, lexicon).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    got = {r.doc_id: r.predicted for r in rows}
    assert all(got[i] == (i % 4 == 0) for i in range(240))
    assert [got[i] for i in (1000, 1001, 1002, 1003, 1004, None)] == [0, 0, 1, 0, 0, 0]
    kept = keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in got if not got[i]}


def test_folding_and_empty(spark):
    assert fold("1D10T Іdіοt ｉｄ") == "idiot idiot id"
    docs, labels = corpus(spark)
    assert score_toxicity(docs, learn_lexicon(docs, labels.limit(0))).where("score > 0").count() == 0
    assert score_toxicity(docs.limit(0), Lexicon({})).count() == 0


def naive_score(text, lexicon):
    """The same score by looking each word of the folded text up, without an automaton."""
    text = fold(text or "")
    words = [m[0] for m in re.finditer(r"[^\W\d_]+", text)]
    total, kinds = 0.0, set()
    for i, w in enumerate(words):
        weight = 0.0
        for n in range(len(w), 0, -1):
            weight = (lexicon.weights.get(w) if n == len(w) else None) or lexicon.weights.get(w[:n] + "*") or 0.0
            if weight:
                break
        around = {f"{words[i - 1]} {w}"} if i else set()
        if i + 1 < len(words):
            around.add(f"{w} {words[i + 1]}")
        if weight and not around & lexicon.exceptions:
            total += weight
            kinds.add(w)
    length = text.count(" ") + text.count("\n") + 1
    x = (1.0, math.log1p(total), math.log1p(100 * total / (length + 10)), math.log1p(len(kinds))) if kinds else (1.0, 0.0, 0.0, 0.0)
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, lexicon.model))))


def test_automaton_agrees_with_naive_matching(spark, monkeypatch):
    rnd = random.Random(8)
    long = "z" * 60 + "bad"
    lexicon = Lexicon({"bad": 2.0, "badly*": 3.0, "ba*": 1.7, "worse": 2.5, "worse*": 1.9, "ïdiot": 4.0, long: 5.0}, {"not bad", "worse luck", f"{'y' * 50} bad"}, [-3.0, 1.1, 0.7, 0.4])
    bits = ["bad", "badly", "badlys", "bas", "b4d", "wоrse", "worses", "luck", "not", "ïdiot", "x", long, "y" * 50, "7", "²", "...", "\n", "bad-bad", "_bad", "bad_", "—" * 60]
    texts = [" ".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 25))) for _ in range(400)] + [None, "", "bad", "not" + " ." * 100 + " bad"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in score_toxicity(df, lexicon).collect()}
    for i, t in enumerate(texts):
        assert abs(rows[i].score - naive_score(t, lexicon)) < 1e-12, t
        assert rows[i].predicted == (rows[i].score >= 0.3)
    # and over a whole table with the lexicon learnt from it
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    learnt = learn_lexicon(docs, labels.where(~held_out()))
    monkeypatch.setattr(toxicity, "learn_lexicon", lambda *_, **__: learnt)
    scored = {r.doc_id: r.score for r in op2_toxicity(spark, d).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert learnt.weights and scored.keys() == texts.keys() and all(abs(scored[i] - naive_score(t, learnt)) < 1e-12 for i, t in texts.items())


def test_terms_counted_in_steps(spark, monkeypatch):
    docs, labels = corpus(spark)
    whole = learn_lexicon(docs, labels)
    monkeypatch.setattr(toxicity, "COUNTED_TERMS", 50)
    assert learn_lexicon(docs, labels) == whole


def test_rows_pass_with_any_columns(spark):
    docs, labels = corpus(spark)
    odd = docs.withColumnRenamed("word", "toxic").withColumn("_id", toxicity.F.array(toxicity.F.lit(1)))
    kept = keep_clean(odd, labels)
    assert kept.columns == odd.columns and kept.count() == keep_clean(docs, labels).count()
    assert keep_clean(docs.limit(0), labels).count() == 0 and keep_clean(docs, labels.limit(0)).count() == docs.count()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in op2_toxicity(spark, d).collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    hit = sum(r.predicted and labels[r.doc_id] for r in rows)
    assert hit >= 0.93 * sum(labels[r.doc_id] for r in rows) and hit >= 0.93 * sum(r.predicted for r in rows)


def test_repeated_labelled_ids_do_not_fill_the_driver(spark, monkeypatch):
    docs, labels = corpus(spark)
    many = docs.unionByName(docs.where("doc_id = 4")).unionByName(docs.where("doc_id = 4"))
    for i in range(60):
        many = many.unionByName(docs.where("doc_id = 8").selectExpr("doc_id", f"concat(text, ' t{i}') as text", "word", "score"))
    # equal rows are one row, and of different texts of an id no more than the bound count
    plain, repeated = learn_lexicon(docs, labels), learn_lexicon(docs.unionByName(docs), labels)
    assert plain.weights == repeated.weights and plain.model == repeated.model
    sizes = []
    real = toxicity._logistic
    monkeypatch.setattr(toxicity, "_logistic", lambda x, y: sizes.append(len(y)) or real(x, y))
    assert learn_lexicon(many, labels, sample_rows=100).model is not None
    assert sizes == [100]
    monkeypatch.setattr(toxicity, "EXCEPTIONS", 1)
    assert len(learn_lexicon(docs, labels).exceptions) <= 1
