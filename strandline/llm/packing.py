"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed capacity.

Best fit treats pieces of one length alike, and bins of one remaining capacity alike. So the whole
corpus is packed from its length histogram (at most ``capacity`` rows, whatever the corpus size): a
segment tree over remaining capacities finds the tightest open bins in O(log capacity) for each run of
equal pieces, and the runs say where the r-th piece of a length goes. Spark tokenises, counts, ranks
the pieces of each length and looks their runs up.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.inputs import read_spread
from strandline.operators.components import cut_lineage

CAPACITY, END_ID = 4096, 1
#: Bytes, about, of the words whose ids a worker remembers; when so many are new, those of the time before are forgotten. Longer words are not remembered.
REMEMBERED_BYTES, LONGEST_REMEMBERED = 48 << 20, 48
#: What an entry costs besides its characters and ids.
ENTRY_BYTES = 130
#: Pieces of one length that are ranked together, about.
RANKED_ROWS = 250_000


class _WordIds(dict):
    """White-space free stretch of text -> its ids as little-endian uint32 bytes, filled as it is asked.

    A stretch of plain parts (runs of Latin letters, single digits, runs of ASCII marks without the
    apostrophe) is looked up part by part, and a new part goes straight to the tokenizer's model. That
    holds where the tokenizer lower-cases and cuts at exactly these parts, which is tried out on loading;
    all else is encoded as a whole.
    """

    def __init__(self, path: str, most: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.before: dict[str, bytes] = {}
        self.held, self.most = 0, REMEMBERED_BYTES if most is None else most
        self.mapped = {i: self._byte_text(i) for i in range(0xDF, 0x100) if i != 0xF7}
        self.plain = all(self._by_parts(x) == self._whole(x) for x in _PROBES)

    @staticmethod
    def _byte_text(code: int) -> str:
        """The letter as byte-level models write it: printable bytes as they are, the others from U+0100 on."""
        odd = [*range(33), *range(127, 161), 173]
        return "".join(chr(256 + odd.index(b)) if b in odd else chr(b) for b in chr(code).encode())

    def _whole(self, stretch: str) -> bytes:
        return np.array(self.tokenizer.encode(stretch, add_special_tokens=False).ids, "<u4").tobytes()

    def _by_parts(self, stretch: str) -> bytes | None:
        low = stretch.lower()
        if low.isascii() and low.isalpha():
            parts = [low]
        elif not _PLAIN(low) or "<|" in low or len(low) != len(stretch):
            return None
        else:
            parts = _PARTS(low)
        out = []
        for part in parts:
            ids = self.get(part) or self.before.get(part)
            if ids is None:
                text = part if part.isascii() else part.translate(self.mapped)
                ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(text)])
                if part != stretch:
                    self._remember(part, ids)
            out.append(ids)
        return b"".join(out)

    def _remember(self, stretch: str, ids: bytes) -> None:
        if len(stretch) > LONGEST_REMEMBERED:
            return
        cost = 2 * len(stretch) + len(ids) + ENTRY_BYTES
        if self.held + cost > self.most:
            self.before = dict(self)
            self.clear()
            self.held = 0
        self.held += cost
        self[stretch] = ids

    def __missing__(self, stretch: str) -> bytes:
        ids = self.before.get(stretch)
        if ids is None:
            ids = self._by_parts(stretch) if self.plain else None
            if ids is None:
                ids = self._whole(stretch)
        self._remember(stretch, ids)
        return ids


_PLAIN = re.compile(r"(?:[a-z\u00df-\u00f6\u00f8-\u00ff0-9]|[!-&(-/:-@\[-`{-~])*").fullmatch
_PARTS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00ff]+").findall
_PROBES = ["Abc", "\u00c9t\u00c9", "no.1_2+", "x\u00ff#%", "(a)b", "42a7", "".join(chr(i) for i in range(0xC0, 0x100) if i not in (0xD7, 0xDF, 0xF7)), "stra\u00dfe"]
_LOADED: dict[str, _WordIds] = {}
#: str.split() cuts at these, the tokenizer's white space does not include them.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"


def _stretches(text: str) -> list[str]:
    if any(c in text for c in _NOT_SPACE):
        return text.replace("\n", " ").split(" ")
    return text.split()


def _tokenise(path: str, capacity: int, end_id: int, remembered: int | None = None):
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED or remembered not in (None, _LOADED[path].most):
            _LOADED[path] = _WordIds(path, remembered)
        ids_of = _LOADED[path]
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = b"".join(map(ids_of.__getitem__, _stretches(text or "")))
                    ids += end
                    for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[i : i + 4 * capacity]
                        rows.append((doc_id, k, i // 4, len(cut) // 4, zlib.crc32(cut)))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity that finds the least one, of at least a given size, with open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _add(self, left: int, n: int) -> None:
        i = left + self.leaves
        while i:
            self.open[i] += n
            i >>= 1

    def push(self, left: int, first: int, bins: int) -> None:
        """Open ``bins`` bins from number ``first`` on, with ``left`` remaining each."""
        if bins and left:
            self.ranges[left].append((first, bins))
            self._add(left, bins)

    def pop(self, left: int) -> tuple[int, int]:
        first, bins = self.ranges[left].pop()
        self._add(left, -bins)
        return first, bins

    def tightest(self, need: int) -> int | None:
        i = need + self.leaves
        if not self.open[i]:
            while i > 1 and (i & 1 or not self.open[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first bin, pieces a bin, offset in the bin) of best fit decreasing over length -> count.

    At most two new bin ranges arise for each length, so the runs are bounded by the capacity alone.
    """
    tree, runs, bins_used = CapacityTree(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, bins = capacity, bins_used, -(-left // (capacity // length))
                bins_used += bins
            else:
                first, bins = tree.pop(room)
            each = room // length
            full = min(bins, left // each)
            runs.append((length, rank, first, each, capacity - room))
            tree.push(room - each * length, first, full)
            rank, left = rank + full * each, left - full * each
            if left and full < bins:  # the last pieces open one bin of the range
                tree.push(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            tree.push(room, first + full, bins - full)
    return runs


def _place(length: np.ndarray, rank: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = (runs[:, 0] << 48) + runs[:, 1]
    run = runs[np.searchsorted(key, (length << 48) + rank, "right") - 1]
    past = rank - run[:, 1]
    return run[:, 2] + past // run[:, 3], run[:, 4] + past % run[:, 3] * length


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", remembered: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids plus end_id, cut only where longer than capacity.

    Ids are looked up for stretches between white space, at which this kind of tokenizer (white space
    dropped before the words) never joins anything. A worker remembers the ids of stretches in at most
    twice ``remembered`` bytes, about (REMEMBERED_BYTES if None), which only saves encoding them again.
    """
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(_tokenise(tokenizer_path, capacity, end_id, remembered), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", remembered: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    Null and empty texts are one piece of end_id; only texts of more than capacity tokens are cut. Rows
    repeat as they come; a null doc_id stays null. An empty table gives no rows; other columns, also such
    as are named like the result's, are ignored.
    """
    pieces = cut_lineage(tokenised_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, remembered))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = np.array(sorted(best_fit_runs(counts, capacity)) or np.empty((0, 5)), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(runs)
    salts = max(8, -(-max(counts.values(), default=0) // RANKED_ROWS))
    # by place in the checkpoint, so that copies of one row are dealt, too
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.select("length", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("skip"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("at", within).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("skip") + F.col("at") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = _place(b.column("length").to_numpy(), b.column("rank").to_numpy(), shared.value) if len(b) else (np.empty(0, np.int64),) * 2
            yield pa.record_batch([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_pack(read_spread(spark, f"{sf_dir}/documents.parquet", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
