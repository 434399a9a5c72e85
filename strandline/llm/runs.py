"""Periodic runs of words by block convolution.

At scale B (a power of two) the words are cut into blocks of B. The sum of squared differences between a
block and each place of the window behind it is one correlation, computed by an exact number-theoretic
transform; a sum of zero is a copy of the block, and its distance a seed. Each run of a period in
[B, 2B) holds a whole block and a copy of it at that distance, so that no run is missed. Seeds are
extended by comparing the words themselves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.inputs import read_spread

#: The transform's prime 7 * 2**20 + 1 and a root of it. Products of RADIX residues add up below 2**53, so double matrix products are exact.
PRIME, ROOT, RADIX = 7_340_033, 3, 128
#: First and last scale; longer periods take further windows of blocks of the last scale.
LEAST_BLOCK, MOST_BLOCK = 8, 1 << 19
#: Words of a group of documents that pass together (a longer document is alone) and entries of a transform's array, about.
GROUP_WORDS, ARRAY = 1 << 16, 1 << 15


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, up to a whole PRIME more or a unit less by rounding of the quotient."""
    q = x * (1.0 / PRIME)
    np.floor(q, out=q)
    q *= PRIME
    return np.subtract(x, q, out=q)


@lru_cache(maxsize=None)
def _powers(n: int, rows: int, columns: int) -> np.ndarray:
    """w ** (i * j) of an n-th root of unity w, for i < rows and j < columns."""
    w = pow(ROOT, (PRIME - 1) // n, PRIME)
    table = np.ones(n, np.int64)
    for i in range(1, n):
        table[i] = table[i - 1] * w % PRIME
    return table[np.outer(np.arange(rows), np.arange(columns)) % n].astype(np.float64)


def transform(x: np.ndarray) -> np.ndarray:
    """The number-theoretic transform of each row (a power of two, 2**20 at most), modulo PRIME; by matrix products of RADIX."""
    rows, n = x.shape
    if n <= RADIX:
        return _mod(x @ _powers(n, n, n))
    y = _mod(_powers(RADIX, RADIX, RADIX) @ x.reshape(rows, RADIX, n // RADIX))
    y = _mod(y * _powers(n, RADIX, n // RADIX))
    y = transform(y.reshape(rows * RADIX, n // RADIX)).reshape(rows, RADIX, n // RADIX)
    return y.transpose(0, 2, 1).reshape(rows, n)


def copies(values: np.ndarray, blocks: np.ndarray, size: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of blocks, distances) where the squared differences add up to zero modulo PRIME.

    values: residues, padded by three blocks. Distances are gap * size up to size - 1 more; with gap 0
    from 1 to 2 * size - 1. A sum that is a multiple of PRIME without being zero gives a false copy, a
    true one is never missed.
    """
    n = 2 * size if gap else 4 * size
    parts = [gap, gap + 1] if gap else [0, 1, 2]
    shifts = np.arange(size) if gap else np.arange(1, 2 * size)
    back, out = -np.arange(n) % n, ([], [])
    # n / 2 times the squares, summed up to each place, and over the size words from each place on
    squares = np.concatenate([[0.0], np.cumsum(_mod(_mod(values * values) * (n // 2)))])
    sums = squares[size:] - squares[:-size]
    # the part k blocks behind the window's start is turned by w ** (k * size * j), which is 1 or -1 where a window has two blocks
    turns = [np.where(np.arange(n) % 2 * k, -1.0, 1.0) if gap else _powers(n, k * size + 1, n)[-1] for k in range(len(parts))]
    step = max(1, ARRAY // n)
    for i in range(0, len(blocks), step):
        own = blocks[i : i + step]
        need, place = np.unique(own[:, None] + np.array([0, *parts])[None, :], return_inverse=True)
        place = place.reshape(len(own), -1)
        padded = np.zeros((len(need), n))
        padded[:, :size] = values[need[:, None] * size + np.arange(size)]
        spectrum = transform(padded)
        window = spectrum[place[:, 1]]
        for k in range(1, len(parts)):
            window += spectrum[place[:, 1 + k]] * turns[k] if gap else _mod(spectrum[place[:, 1 + k]] * turns[k])
        # factors below PRIME and 3 * PRIME in size; the result is n times the correlation, from back to front
        product = transform(_mod(spectrum[place[:, 0]][:, back] * window))
        at = own * size
        far = at[:, None] + gap * size + shifts[None, :]
        both = sums[far]
        both += (squares[at + size] - squares[at])[:, None]
        both -= product[:, -shifts % n]
        rest = _mod(both)
        row, shift = np.nonzero((rest == 0) | (rest == PRIME))
        out[0].append(at[row])
        out[1].append(gap * size + shifts[shift])
    return tuple(np.concatenate(o) if o else np.empty(0, np.int64) for o in out)


def _same_length(a: np.ndarray, b: np.ndarray) -> int:
    """How far two equally long arrays agree from their starts."""
    at, step = 0, 64
    while at < len(a):
        other = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if len(other):
            return at + int(other[0])
        at, step = at + step, step * 2
    return len(a)


def _primes_of(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return out + [n] * (n > 1)


class Finder:
    """Runs of a group of documents whose words are one array of numbers; document k is words starts[k] to starts[k + 1]."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, least: int, repeats: int):
        self.words, self.starts, self.least, self.repeats = words, starts, least, repeats
        self.runs: list[tuple[int, int, int]] = []  # (start, end, period)

    def find(self) -> list[tuple[int, int, int]]:
        sizes = np.diff(self.starts)
        most = int(sizes.max(initial=0))
        if most < self.least:
            return []
        residues = (self.words * 2_654_435 + 12_345) % PRIME
        size = LEAST_BLOCK
        while True:
            gaps = [0] if size == LEAST_BLOCK else [1] if size < MOST_BLOCK else range(1, most // (self.repeats * size) + 1)
            for gap in gaps:
                shortest = max(1, gap * size)
                blocks = self._blocks(size, shortest, sizes)
                if len(blocks):
                    end = (int(blocks[-1]) + gap + 4) * size
                    values = np.zeros(max(end, len(residues)))
                    values[: len(residues)] = residues
                    self._extend_all(*copies(values, blocks, size, gap), size)
            if size >= MOST_BLOCK or self.repeats * 2 * size > most:
                return sorted(self.runs)
            size *= 2

    def _blocks(self, size: int, shortest: int, sizes: np.ndarray) -> np.ndarray:
        """The blocks that lie in one document which can hold a run of such a period, with room behind for a copy."""
        first, end = self.starts[:-1], self.starts[1:]
        fit = sizes >= max(self.least, self.repeats * shortest)
        low, high = -(-first[fit] // size), (end[fit] - size - shortest) // size + 1
        count = np.maximum(0, high - low)
        return np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())

    def _extend_all(self, place: np.ndarray, distance: np.ndarray, size: int) -> None:
        document = np.searchsorted(self.starts, place, "right") - 1
        inside = place + distance + size <= self.starts[document + 1]
        order = np.argsort(place[inside], kind="stable")
        place, distance = place[inside][order], distance[inside][order]
        if size > LEAST_BLOCK:
            self._extend(*self._unknown(place, distance, size), size)
            return
        for q in range(1, 2 * size):  # a run found here explains seeds of multiples of its period
            at = place[distance == q]
            self._extend(*self._unknown(at, np.full(len(at), q), size), size)

    def _unknown(self, place: np.ndarray, distance: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Seeds but those inside a known run at a multiple of its period: around them lies that run."""
        keep = np.ones(len(place), bool)
        for start, end, period in self.runs if len(place) else ():
            i, j = np.searchsorted(place, [start, end])
            keep[i:j] &= (distance[i:j] % period != 0) | (place[i:j] + distance[i:j] + size > end)
        return place[keep], distance[keep]

    def _extend(self, place: np.ndarray, distance: np.ndarray, size: int) -> None:
        last_q, last_end = 0, 0
        order = np.lexsort((place, distance))
        for at, q in zip(place[order].tolist(), distance[order].tolist(), strict=True):
            if q == last_q and at + q + size <= last_end:
                continue
            k = int(np.searchsorted(self.starts, at, "right")) - 1
            low, high = int(self.starts[k]), int(self.starts[k + 1])
            right = at + _same_length(self.words[at : high - q], self.words[at + q : high])
            if right - at < size:
                continue  # a sum that was a multiple of the prime
            left = at - _same_length(self.words[low:at][::-1], self.words[low + q : at + q][::-1])
            last_q, last_end = q, right + q
            if last_end - left >= max(self.least, self.repeats * q) and self._is_least(left, q):
                self.runs.append((left, last_end, q))

    def _is_least(self, start: int, q: int) -> bool:
        """Whether no divisor of q is a period, too; with two periods' length at least, no other number can be."""
        block = self.words[start : start + q]
        return not any(np.array_equal(block[: q - q // r], block[q // r :]) for r in _primes_of(q))


def runs_of(documents: list[list[bytes]], least: int = 24, repeats: int = 3) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = []
    group, held = [], 0
    for i, words in enumerate(documents):
        group.append(words)
        held += len(words)
        if held >= GROUP_WORDS or i == len(documents) - 1:
            known: defaultdict[bytes, int] = defaultdict()
            known.default_factory = known.__len__
            numbers = np.fromiter(map(known.__getitem__, chain.from_iterable(group)), np.int64, held)
            starts = np.concatenate([[0], np.cumsum([len(ws) for ws in group])]).astype(np.int64)
            found: list[list[tuple[int, int, int]]] = [[] for _ in group]
            for start, end, period in Finder(numbers, starts, least, repeats).find():
                k = int(np.searchsorted(starts, start, "right")) - 1
                found[k].append((start - int(starts[k]), end - start, period))
            out += found
            group, held = [], 0
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def _search(least: int, repeats: int):
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = 0
            while i < len(batch):
                # as many rows as make a group, so that no more words are held than that
                words, held = [], 0
                while i < len(batch) and held < GROUP_WORDS:
                    text = batch.column(1)[i].as_py()
                    words.append((text or "").encode().split())  # of ASCII white space: the word pattern's six bytes
                    held += len(words[-1])
                    i += 1
                found = runs_of(words, least, repeats)
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
                texts = [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, found, strict=True)]
                yield pa.record_batch([batch.column(0).slice(i - len(words), len(words)), pa.array(rows, run_type), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    return run


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, repeats: int = 3) -> DataFrame:
    """(doc_id, runs, collapsed) of every row: its periodic runs of words and its text without their repeats.

    Words are maximal stretches of other characters than the six of ASCII white space. A run is a stretch
    with smallest period q of at least max(least, repeats * q) words that neither neighbouring word
    extends; least is at least 3 * 8, repeats at least 3. runs: array of (start, length, period), numbered
    from 0, by start, then period. collapsed: the words that no run holds after its first q words, joined
    by one space. Null, empty and blank texts have no run and an empty text; rows repeat as they come; an
    empty table gives no rows; other columns of any name are ignored. Texts are taken whole: work grows
    with words times the logarithm of the longest text, memory with one group of words or the longest text.
    """
    if least < 3 * LEAST_BLOCK or repeats < 3:
        raise ValueError("runs of fewer than 24 words or three periods are not all found")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_search(least, repeats), f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted_text(doc_id: Column, text: Column) -> Column:
    """The query's input: one document in ten, by the CRC-32 of its id, has a periodic tail; the others are as they are (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(1))
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), (F.floor((n - a) / p) + 1).cast("int")))
    changed = F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(changed, " ")).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_spread(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    found = collapse_runs(docs.select("doc_id", planted_text(F.col("doc_id"), F.col("text")).alias("text")))

    def before(a: Column, b: Column) -> Column:
        """-1 where a is the better run: the greater length / period exactly, then the smaller start, then period."""
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(x > y, -1).when(x < y, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["period"] < b["period"], -1).otherwise(F.when(a["period"] > b["period"], 1).otherwise(0))

    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.get(F.array_sort("runs", before), 0)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
