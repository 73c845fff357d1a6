"""Byte-level BPE encoding and decoding on length-bucketed padded matrices.

A text is split by a pattern; each piece is encoded on its own. Pieces that are
tokens as they stand need no merges. The others of a batch are laid out, one row for
each distinct piece, in matrices of rows of like length. In every round each row
merges its leftmost pair of minimum rank; pairs are looked up in an open-addressing
hash table of all pairs at once, and the rows are compacted. Further places of the
same rank are merged in the same round, up to the first whose merge makes a pair of
lower rank, since they would be the next ones anyway. So a row of one letter repeated
a million times needs rounds by the logarithm of its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import held, ship

NONE = np.int32(2**31 - 1)
CHUNK_CHARS = 1 << 19  # text handled at once in a worker
CACHE_PIECES = 200_000  # distinct pieces a worker remembers before it starts afresh
# Fixed value: the Unicode White_Space characters, which \s means in the pattern.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"


class PairTable:
    """Hash table from a pair of token ids to the id of the merged token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        size = 1 << int(np.ceil(np.log2(max(16, 4 * len(left)))))
        self.shift, self.mask = np.uint64(64 - int(np.log2(size))), size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        slots, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slots[todo]] == -1
            self.keys[slots[todo[free]]] = keys[todo[free]]  # of several for one slot the last one stays
            placed = self.keys[slots[todo]] == keys[todo]
            self.values[slots[todo[placed]]] = merged[todo[placed]]
            todo = todo[~placed]
            slots[todo] = (slots[todo] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, ``NONE`` where the pair does not merge."""
        keys = (left.astype(np.int64) << 32) | right
        slots = self.slot(keys)
        out = np.full(len(keys), NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            seen = self.keys[slots[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[slots[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
            slots[todo] = (slots[todo] + 1) & self.mask
        return out


class Vocabulary:
    """Ranks of a rank file (lines of base64 token and rank) and the pattern that splits text."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        self.whole = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens: dict[int, bytes] = {rank: token for token, rank in self.whole.items()}
        self.single = np.array([self.whole[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in self.whole.items():
            for cut in range(1, len(token)):
                a, b = self.whole.get(token[:cut]), self.whole.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        left, right, merged = np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int64)
        lowest = np.full(max(self.tokens) + 1, NONE, np.int64)  # rank of the best pair that holds a token
        np.minimum.at(lowest, left, merged)
        np.minimum.at(lowest, right, merged)
        self.repeats = lowest > np.arange(len(lowest))
        self.pairs = PairTable(left, right, merged)
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]")).findall

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece, by merges."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            buckets.setdefault(max(len(piece) - 1, 0).bit_length(), []).append(i)
        for wide, rows in buckets.items():
            step = max(1, (1 << 20) >> wide)
            for start in range(0, len(rows), step):
                self.merge_rows([pieces[i] for i in rows[start : start + step]], rows[start : start + step], out)
        return out

    def merge_rows(self, pieces: list[bytes], names: list[int], out: list[np.ndarray]) -> None:
        sizes = np.array([len(p) for p in pieces], np.int64)
        rows = np.array(names, np.int64)
        ids = np.zeros((len(pieces), int(sizes.max()) + 1), np.int32)
        ids[np.arange(ids.shape[1]) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full(ids.shape, NONE, np.int32)  # of the pair that begins at a place
        fresh = np.arange(ids.shape[1]) < sizes[:, None] - 1
        while True:
            at_row, at = np.nonzero(fresh)
            ranks[at_row, at] = self.pairs.find(ids[at_row, at], ids[at_row, at + 1])
            first = ranks.argmin(axis=1)
            low = ranks[np.arange(len(ids)), first]
            done = low == NONE
            for i in np.flatnonzero(done).tolist():
                out[rows[i]] = ids[i, : sizes[i]].copy()
            if done.all():
                return
            if done.any():
                ids, ranks, rows, sizes = ids[~done], ranks[~done], rows[~done], sizes[~done]
                first, low = first[~done], low[~done]
            place = np.arange(ids.shape[1])
            hits = ranks == low[:, None]
            starts = hits.copy()
            starts[:, 1:] &= ~hits[:, :-1]
            run = np.maximum.accumulate(np.where(starts, place, 0), axis=1)
            hits &= (place - run) % 2 == 0  # of overlapping places every other one, from the left
            hits &= place <= self.first_that_yields(ids, hits, low)[:, None]
            ids[hits] = np.broadcast_to(low[:, None], ids.shape)[hits]
            keep = place < sizes[:, None]
            keep[:, 1:] &= ~hits[:, :-1]
            sizes = keep.sum(axis=1)
            changed = hits.copy()
            changed[:, :-1] |= hits[:, 1:]
            changed[:, :-2] |= hits[:, 2:] & ~keep[:, 1:-1]  # before a merged pair may stand another one
            width = int(sizes.max()) + 1
            into = np.arange(width) < sizes[:, None]

            def compact(cells: np.ndarray, rest, into=into, keep=keep, width=width) -> np.ndarray:
                new = np.full((len(cells), width), rest, cells.dtype)
                new[into] = cells[keep]
                return new

            ids, ranks, fresh = compact(ids, 0), compact(ranks, NONE), compact(changed, False)
            last = np.arange(width) >= sizes[:, None] - 1
            ranks[last] = NONE
            fresh &= ~last

    def first_that_yields(self, ids: np.ndarray, hits: np.ndarray, low: np.ndarray) -> np.ndarray:
        """For each row the first place whose merge makes a pair of lower rank; the others wait for that."""
        limit = np.full(len(ids), ids.shape[1])
        several = np.flatnonzero((hits.sum(axis=1) > 1) & ~self.repeats[low])
        row, at = np.nonzero(hits[several])
        row = several[row]
        token = low[row]
        before = np.where((at > 1) & hits[row, at - 2], token, ids[row, at - 1])
        made = self.pairs.find(before, token)
        made[at == 0] = NONE
        made = np.minimum(made, self.pairs.find(token, np.append(ids, np.zeros((len(ids), 1), ids.dtype), axis=1)[row, at + 2]))
        np.minimum.at(limit, row[made < token], at[made < token])
        return limit

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class Encoder(dict):
    """Texts to ids with a store of the pieces met so far: piece -> its place in the store."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.ids = np.empty(0, np.int32)
        self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, piece: str) -> int:
        self[piece] = place = len(self)
        self.new.append(piece)
        return place

    def learn(self) -> None:
        whole = self.vocabulary.whole
        pieces = [p.encode() for p in self.new]
        found = [whole.get(p) for p in pieces]
        rest = [i for i, f in enumerate(found) if f is None]
        arrays = [np.array([f or 0], np.int32) for f in found]
        for i, ids in zip(rest, self.vocabulary.encode_pieces([pieces[i] for i in rest]), strict=True):
            arrays[i] = ids
        sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.ids = np.concatenate((self.ids, *arrays))
        self.new = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > CACHE_PIECES:
            self.forget()
        split = self.vocabulary.split
        places, counts = [], []
        for text in texts:
            pieces = split(text)
            places.append(np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces)))
            counts.append(len(pieces))
        if self.new:
            self.learn()
        place = np.concatenate(places) if places else np.empty(0, np.int64)
        sizes = self.size[place]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.start[place] - ends + sizes, sizes)]
        bounds = np.concatenate(([0], ends))[np.cumsum([0, *counts])]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def loaded(ranks: bytes, pattern: str) -> Encoder:
    """The encoder of a rank file, kept for the next tasks of this worker."""
    name = "bpe", hashlib.sha256(ranks + pattern.encode()).digest()
    return held(name, lambda: Encoder(Vocabulary(ranks, pattern)))


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def groups_of(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    some, chars = [], 0
    for text in texts:
        some.append(text)
        chars += len(text)
        if chars >= most:
            yield some
            some, chars = [], 0
    if some:
        yield some


def encode(
    docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """``(doc_id, ids)``, with ``decoded`` also the bytes that the ids decode to: one row for each row of ``docs``; ids are unsigned 32-bit integers, low byte first.

    A null text counts as empty and has no ids. Ids and repeated rows pass through as they are;
    other columns are not looked at; an empty table gives no rows. The rank file is the only
    thing broadcast: its size is that of a vocabulary and does not follow the data.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(*shared.value)
        for batch in batches:
            out: list[bytes] = []
            for texts in groups_of([t or "" for t in batch.column(1).to_pylist()]):
                out += [ids.astype("<u4").tobytes() for ids in encoder.encode(texts)]
            columns = [batch.column(0), pa.array(out, pa.binary())]
            if decoded:
                back = [encoder.vocabulary.decode(np.frombuffer(x, "<u4")) for x in out]
                columns.append(pa.array(back, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])
        encoder.forget()  # an idle worker holds the vocabulary only

    kind = docs.schema[id_col].dataType.simpleString()
    more = ", decoded binary" if decoded else ""
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids binary{more}")


def decode(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``(doc_id, ids, decoded)``: the bytes that the ids of ``encode`` stand for; null ids give no bytes."""
    spark: SparkSession = encoded.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(*shared.value).vocabulary
        for batch in batches:
            out = [vocabulary.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")
