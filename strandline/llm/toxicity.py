"""Toxicity by a weighted lexicon: folded text, Aho-Corasick matching, exception phrases, length normalisation.

Lexicon, exceptions and calibration are learnt from a bounded sample of labelled rows; whole texts of
all rows are then scored on the executors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.inputs import read_spread
from strandline.operators.components import cut_lineage

#: Labelled rows that are learnt from at most, by order of a hash of the id.
SAMPLE_ROWS = 8000
#: An entry needs so many toxic rows and this weight (log odds); the heaviest LEXICON_SIZE stay.
MIN_ROWS, MIN_WEIGHT, LEXICON_SIZE = 6, 1.6, 2000
#: Stems (beginnings of words) of these lengths are entries beside whole words.
STEMS = range(4, 9)
#: Terms that a task counts before it hands its counts on.
COUNTED_TERMS = 100_000
#: A phrase is an exception from so many clean rows on, with at most one toxic row in so many clean ones.
EXCEPTION_ROWS, EXCEPTION_RATIO = 3, 4
#: Exception phrases at most, those of most clean rows first.
EXCEPTIONS = 20_000
THRESHOLD = 0.3

# Digits and marks written for letters, and letters of other scripts that look Latin.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "т": "t", "у": "y", "х": "x", "ԝ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
_LOOKALIKES = str.maketrans(HOMOGLYPHS | {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {chr(0xFF10 + int(d)): c for d, c in SUBSTITUTES.items() if d.isdigit()})
_HAS_LOOKALIKE = re.compile("[" + "".join(map(chr, _LOOKALIKES)) + "]").search
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, with lookalike letters and digits written for letters put back."""
    text = text.lower()
    if not text.isascii() and _HAS_LOOKALIKE(text):
        text = text.translate(_LOOKALIKES)
    for a, b in SUBSTITUTES.items():
        text = text.replace(a, b)
    return text


@dataclass
class Lexicon:
    """weights: entry -> weight, an entry ending in ``*`` being a stem; exceptions: two-word phrases; model: logistic coefficients."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    model: list[float] = field(default_factory=list)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            key = entry.rstrip("*")
            old = found.get(key, (len(key), 0.0, 0.0))
            found.add_word(key, (len(key), old[1], weight) if entry.endswith("*") else (len(key), weight, old[2]))
        if self.weights:
            found.make_automaton()
        return found


_is_letter = re.compile(r"[^\W\d_]").match


def _letter(text: str, i: int) -> bool:
    return 0 <= i < len(text) and _is_letter(text, i) is not None


def hits(text: str, automaton) -> list[tuple[int, int, float]]:
    """(start, end of word, weight) for each word of folded text that is an entry or has a stem; the longest entry of a word counts."""
    best: dict[int, tuple[int, float]] = {}
    if not len(automaton):
        return []
    for end, (size, whole, stem) in automaton.iter(text):
        start = end - size + 1
        if _letter(text, start - 1):
            continue
        weight = stem if _letter(text, end + 1) or not whole else whole
        if weight and best.get(start, (0,))[0] <= size:
            best[start] = (size, weight)
    out = []
    for start, (size, weight) in sorted(best.items()):
        end = start + size
        while _letter(text, end):
            end += 1
        out.append((start, end, weight))
    return out


def phrases(text: str, start: int, end: int) -> list[str]:
    """The word at start:end with the word before it, and with the word after it."""
    own, out, stop = text[start:end], [], start
    while stop and not _letter(text, stop - 1):
        stop -= 1
    if stop:
        at = stop
        while _letter(text, at - 1):
            at -= 1
        out.append(f"{text[at:stop]} {own}")
    if (after := _WORD.search(text, end)) is not None:
        out.append(f"{own} {after[0]}")
    return out


def features(text: str, automaton, exceptions: set[str]) -> tuple[float, float, float]:
    """log(1 + weight), log(1 + weight in a hundred words), log(1 + different hits); hits in exception phrases don't count."""
    found = [(text[a:b], w) for a, b, w in hits(text, automaton) if not exceptions or exceptions.isdisjoint(phrases(text, a, b))]
    if not found:
        return (0.0, 0.0, 0.0)
    total, words = sum(w for _, w in found), text.count(" ") + text.count("\n") + 1
    return (math.log1p(total), math.log1p(100 * total / (words + 10)), math.log1p(len({w for w, _ in found})))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())

    def counted() -> pa.RecordBatch:
        terms = list(counts[0].keys() | counts[1].keys())
        out = pa.record_batch([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "bad", "good"])
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = set(_WORD.findall(fold(text or "")))
            counts[toxic].update({w[:n] + "*" for w in words for n in STEMS if len(w) > n})
            counts[toxic].update(words)
            if len(counts[0]) + len(counts[1]) > COUNTED_TERMS:
                yield counted()
    yield counted()


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """The lexicon of the labelled rows given (at most sample_rows of them, picked by a hash of the id, then of the text).

    Several labels of one id count as toxic if one is; equal rows are one row. Labels that are neither 0
    nor 1, ids without text and null ids are left out; without rows of both classes the lexicon is empty.
    Texts are read whole, however long. The driver holds the lexicon, EXCEPTIONS phrases and three numbers
    for each of sample_rows rows.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    ids = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    # at most sample_rows ids, and of them as many different texts
    every = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "_id")
    sample = cut_lineage(every.withColumn("_h", F.xxhash64("text")).dropDuplicates(["_id", "_h"]))
    if sample.count() > sample_rows:
        keys = sample.select("_id", "_h").orderBy(F.xxhash64("_id"), "_id", "_h").limit(sample_rows)
        sample = cut_lineage(sample.join(F.broadcast(keys), ["_id", "_h"]))
    sample = sample.select("text", "toxic")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Lexicon({})
    terms = sample.mapInArrow(_count_terms, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (sizes[1] - F.col("bad") + 0.5)) - F.log((F.col("good") + 0.5) / (sizes[0] - F.col("good") + 0.5))
    top = terms.where(f"bad >= {MIN_ROWS}").withColumn("weight", odds).where(f"weight >= {MIN_WEIGHT}").orderBy(F.desc("weight"), "term").limit(LEXICON_SIZE)
    lexicon = Lexicon({r.term: r.weight for r in top.collect()})

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                text = fold(text or "")
                rows += [(p, toxic) for p in {p for a, b, _ in hits(text, automaton) for p in phrases(text, a, b)}]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["phrase", "toxic"])

    seen = sample.mapInArrow(contexts, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    lexicon.exceptions = {r.phrase for r in seen.where(f"good >= {EXCEPTION_ROWS} and bad * {EXCEPTION_RATIO} <= good").orderBy(F.desc("good"), "phrase").limit(EXCEPTIONS).select("phrase").collect()}
    pairs = sample.mapInArrow(_featured(lexicon), "a double, b double, c double, toxic int").collect()
    lexicon.model = _logistic(np.array([r[:3] for r in pairs]), np.array([r[3] for r in pairs]))
    return lexicon


def _featured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            x = [features(fold(t or ""), automaton, lexicon.exceptions) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([*(pa.array([r[i] for r in x], pa.float64()) for i in range(3)), batch.column("toxic")], names=["a", "b", "c", "toxic"])

    return run


def text_scores(texts: list[str | None], lexicon: Lexicon, automaton) -> np.ndarray:
    """Scores 0..1; null and empty texts are texts without hits, an empty lexicon scores 0."""
    if not lexicon.model:
        return np.zeros(len(texts))
    x = np.array([(1.0, *features(fold(t or ""), automaton, lexicon.exceptions)) for t in texts]).reshape(-1, 4)
    return 1 / (1 + np.exp(-np.clip(x @ np.array(lexicon.model), -30, 30)))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row; score is 0..1, predicted is 1 from THRESHOLD on.

    Null and empty texts get the score of a text without hits; long texts are scored whole; an empty
    lexicon scores 0 throughout. Repeated rows repeat; an empty table gives no rows; other columns, of any
    names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            score = text_scores(batch.column(1).to_pylist(), lexicon, automaton)
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text, mod 4, is 2; null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns as they are; learns from the labels that are not held out.

    Null and empty texts have no hits and stay; without labels of both classes all rows stay. Each row is
    judged by its whole text alone, so repeated rows go or stay together. Columns of any name and kind
    pass through; an empty table stays empty.
    """
    lexicon, place = learn_lexicon(docs, labels.where(~held_out()), id_col=id_col, text_col=text_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            score = text_scores(batch.column(place).to_pylist(), lexicon, automaton)
            yield batch.filter(pa.array(score < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_spread(spark, f"{sf_dir}/documents.parquet", "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = learn_lexicon(docs, labels.where(~held_out()))
    return score_toxicity(docs, lexicon).select("doc_id", held_out().alias("held_out"), "score", "predicted")
