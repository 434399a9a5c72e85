"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are laid end to end and their suffixes sorted (as far as the longest
piece reaches); every piece of the vocabulary is found as a range of that array by binary search. The
occurrences are edges from start to end, sorted by position and relaxed: a piece is the last one of the
text up to its end if it may follow the last one of the text up to its start, that is, if the two,
encoded together, stay the two. For a BPE model just one last piece satisfies that at each position.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.inputs import read_spread

SPACE = "▁"
#: Bytes, about, of the words and of the parts of words that a worker remembers; when so many are new, those of the time before are forgotten.
REMEMBERED_BYTES, ENTRY_BYTES, REMEMBERED_PAIRS = 64 << 20, 130, 1_000_000
#: Longer words and parts are forgotten with their batch.
LONGEST_REMEMBERED = 48
#: Rows and bytes of text that are encoded together.
PART_ROWS, PART_BYTES = 512, 4 << 20
#: Characters of a matched batch, about.
BATCH_CHARS = 1 << 19
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
_NORMAL, _BYTE = 1, 6
_START = -1


class Pieces:
    """A BPE model whose pieces hold SPACE only at their start (or nothing else), with identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        byte = [model.is_byte(i) for i in range(n)]
        normal = [i for i in range(n) if not (byte[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.rank = {self.text[i]: (-model.get_score(i), i) for i in normal}
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if byte[i]}
        self.raw = [bytes([int(self.text[i][3:5], 16)]) if byte[i] else b"" if model.is_control(i) else self.text[i].replace(SPACE, " ").encode() for i in range(n)]
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("pieces cross words")
        self.ids = np.array(normal, np.int32)
        size = max(map(len, self.rank))
        self.length = np.array([len(self.text[i]) for i in normal], np.int64)
        self.codes = np.zeros((size, len(normal)), np.int32)
        for k, i in enumerate(normal):
            self.codes[: len(self.text[i]), k] = [ord(c) for c in self.text[i]]
        self.bigrams = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.held_words = self.held_parts = 0

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short text: the best pair, leftmost first, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        """Whether piece right may stand after left (_START or an unknown character: anything)."""
        key = left * 1_000_000 + right
        known = self.pairs.get(key)
        if known is None:
            own = [self.text[right]] if left < 0 else [self.text[left], self.text[right]]
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge("".join(own)) == own
        return known

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, index in self.ids) of every occurrence of every piece, sorted by start."""
        n, depth = len(codes), len(self.codes)
        rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        step = 1
        while step < depth:
            after = np.concatenate([rank[step:] + 1, np.zeros(min(step, n), np.int64)])[:n]
            key = rank * (n + 2) + after
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate([[0], key[order[1:]] != key[order[:-1]]]))
            rank, step = new, 2 * step
        suffixes = np.argsort(rank, kind="stable")
        low, high = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), n, np.int64)
        padded = np.concatenate([codes, np.full(depth, -1, codes.dtype)])
        alive = np.arange(len(self.ids))
        for d in range(depth):
            alive = alive[(self.length[alive] > d) & (low[alive] < high[alive])]
            if not len(alive):
                break
            column, goal = padded[suffixes + d], self.codes[d, alive]
            ends = []
            for shift in (0, 1):  # first place with a code of at least goal, and of more than it
                a, b, want = low[alive].copy(), high[alive].copy(), goal + shift
                while (todo := a < b).any():
                    mid = (a + b) >> 1
                    less = todo & (column[np.minimum(mid, n - 1)] < want)
                    a, b = np.where(less, mid + 1, a), np.where(todo & ~less, mid, b)
                ends.append(a)
            low[alive], high[alive] = ends
        count = np.maximum(high - low, 0)
        piece = np.repeat(np.arange(len(self.ids)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        start = suffixes[place]
        order = np.argsort(start, kind="stable")
        return start[order], piece[order]

    def split(self, word: str) -> list[str]:
        """The word cut between characters that no piece holds side by side; nothing merges across."""
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.bigrams]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def learn(self, words: list[str]) -> None:
        """Encode distinct parts of words into self.parts."""
        text = "\0".join(words) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le"), np.int32)
        start, piece = self.occurrences(codes)
        end = (start + self.length[piece]).tolist()
        ids = self.ids[piece].tolist()
        cut = np.searchsorted(start, np.arange(len(codes) + 1)).tolist()
        last: list = [None] * (len(codes) + 1)
        follows, pairs = self.follows, self.pairs
        at = 0
        for word in words:
            stop = at + len(word)
            last[at] = _START
            for s in range(at, stop):
                left = last[s]
                if left is None:
                    continue
                one = False
                for k in range(cut[s], cut[s + 1]):
                    e = end[k]
                    one = one or e == s + 1
                    if last[e] is None and (follows(left, ids[k]) if (ok := pairs.get(left * 1_000_000 + ids[k])) is None else ok):
                        last[e] = ids[k]
                if not one:  # a character without a piece: its bytes
                    last[s + 1] = -2
            out, e = [], stop
            while e > at:
                if last[e] == -2:
                    out += [self.bytes[b] for b in reversed(text[e - 1].encode())]
                    e -= 1
                else:
                    out.append(last[e])
                    e -= len(self.text[last[e]])
            self.parts[word] = np.array(out[::-1], np.int32).tobytes()
            at = stop + 1

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [_WORDS(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if self.held_words > REMEMBERED_BYTES:
            self.words, self.old_words, self.held_words = {}, self.words, 0
        if self.held_parts > REMEMBERED_BYTES:
            self.parts, self.old_parts, self.held_parts = {}, self.parts, 0
        known, parts = self.words, self.parts
        fresh, asked = {}, {}
        for w in set().union(*cut).difference(known):
            ids = self.old_words.get(w)
            if ids is not None:
                known[w] = ids
                continue
            fresh[w] = ps = self.split(w)
            for p in ps:
                if p not in parts:
                    if (ids := self.old_parts.get(p)) is not None:
                        parts[p] = ids
                    else:
                        asked[p] = None
        asked.pop("\0", None)
        new, size = [], 0
        for part in asked:
            new.append(part)
            size += len(part)
            if size >= BATCH_CHARS:
                self.learn(new)
                new, size = [], 0
        if new:
            self.learn(new)
        parts["\0"] = np.array([self.bytes[0]], np.int32).tobytes()  # the separator of a matched batch
        for w, ps in fresh.items():
            known[w] = b"".join([parts[p] for p in ps])
        out = [np.frombuffer(b"".join(map(known.__getitem__, ws)), np.int32) for ws in cut]
        for w in fresh:
            if len(w) > LONGEST_REMEMBERED:
                del known[w]
            else:
                self.held_words += 2 * len(w) + len(known[w]) + ENTRY_BYTES
        for p in asked:
            if len(p) > LONGEST_REMEMBERED:
                del parts[p]
            else:
                self.held_parts += 2 * len(p) + len(parts[p]) + ENTRY_BYTES
        return out

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return data.decode("utf-8", "replace").removeprefix(" ")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most PART_ROWS rows whose texts have PART_BYTES, about; a longer text is alone."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
    at = 0
    while at < len(batch):
        upto = np.cumsum(size[at : at + PART_ROWS], dtype=np.int64)
        n = max(1, int(np.searchsorted(upto, PART_BYTES, "right")))
        yield batch.slice(at, n)
        at += n


_LOADED: dict[str, Pieces] = {}


def load_pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text as the model's own library gives them; null and empty texts have none.

    Repeated rows repeat, a null id stays null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_pieces(model_path)
        for batch in batches:
            for part in _parts(batch):
                ids = model.encode(part.column(1).to_pylist())
                cuts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of id lists; null lists give null. Encoding and decoding give the text back, but for SPACE itself, which becomes a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_pieces(model_path)
        for batch in batches:
            texts = [None if i is None else model.decode(np.array(i, np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, with the CRC-32 of what they decode to and whether that is the text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_pieces(path)
        for batch in batches:
            for part in _parts(batch):
                texts = part.column(1).to_pylist()
                ids = model.encode(texts)
                back = [model.decode(i) for i in ids]
                cuts = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
                columns = [part.column(0), pa.array(np.diff(cuts)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(np.concatenate(ids)))]
                columns += [pa.array([zlib.crc32(b.encode()) for b in back], pa.int64()), pa.array([b == (t or "").replace(SPACE, " ") for b, t in zip(back, texts, strict=True)])]
                yield pa.record_batch(columns, names=["doc_id", "n_ids", "ids", "decoded_crc32", "round_trip"])

    docs = read_spread(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_ids long, ids array<int>, decoded_crc32 long, round_trip boolean")
