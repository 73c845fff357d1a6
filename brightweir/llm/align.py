"""Cross-tokenizer alignment, with corpus-wide counts of linked token pairs.

A byte-level tokenizer (A) and a piece tokenizer (B) encode the same bytes. Where tokens
of both end at the same byte, the two tokens are linked, and the offsets of links cut the
text into groups. Every pair of ids is counted over the corpus and each document looks
its pairs up:

* First pass: chunks of documents are encoded, aligned, and their links folded to
  distinct pairs with counts, dealt to shards by B id. A shard's distinct pairs, at most
  the product of two vocabularies over the number of shards, get a minimal perfect hash.
  Counts are dense vectors indexed by it; several tasks a shard add up theirs, and the
  vectors are summed in a tree of two levels.
* A minimal perfect hash sends unknown keys anywhere, so every index is verified against
  the key stored at its place.
* Second pass: chunks ask for the counts of their own pairs, shard by shard, and the
  documents of a chunk are aligned again and look up their links.

Nothing is broadcast but the two vocabulary files. No table of all pairs is ever in one
place, and no task holds more than a chunk and a shard.

Encoding goes by pieces that both tokenizers provably treat apart: cut before a blank
that follows a non-space and precedes a letter. There A starts a new word by its pattern,
and B has no token with a blank after another character (checked when it is loaded,
otherwise texts are encoded whole). A worker encodes each distinct piece once. ASCII pieces
are merged by token rank, which is faster, if the vocabulary proves that this is the same.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import held, saved, ship

CHUNK_BYTES = 2 << 20  # of text
STORE_PIECES = 100_000  # distinct pieces that a worker remembers before it starts afresh
LEARN_PIECES = 2_000  # encoded at once
SLICE_BYTES = 1 << 19  # of text aligned at once
SHARDS, SALTS = 16, 8
#: Fixed value: how the byte-level tokenizer splits words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CUT = re.compile(r"(?<=\S)(?= [A-Za-zÀ-ÖØ-öø-ÿ])")
BLANK = "▁"


def byte_letters() -> dict[str, int]:
    """Letter to byte of the byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merges_by_rank(a_file: bytes) -> bool:
    """True if merging the pair whose joined token has the lowest id gives what the list of merges gives.

    Merges go in the order of the list, and a made token only takes part in later ones. A token
    that its own bytes lead to is therefore always made from the one pair it is listed with. So
    it is enough that ids follow the list and that every token is reached from its bytes.
    """
    spec = json.loads(a_file)
    model, shape = spec["model"], spec["pre_tokenizer"] or {}
    if spec["normalizer"] or shape.get("type") != "ByteLevel" or not shape.get("use_regex", True) or shape.get("add_prefix_space"):
        return False
    if any(model.get(option) for option in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return False
    vocabulary = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocabulary.get(a + b) for a, b in pairs]
    if None in made or any(a >= b for a, b in zip(made, made[1:])) or not set(byte_letters()) <= set(vocabulary):
        return False
    rank = {pair: i for i, pair in enumerate(pairs)}
    reached = set(byte_letters())
    for a, b in pairs:
        parts = list(a + b)
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda pair: rank.get(pair, len(pairs)))
            if best not in rank:
                return False
            i, merged = 0, []
            while i < len(parts):
                joined = i + 1 < len(parts) and (parts[i], parts[i + 1]) == best
                merged.append(parts[i] + parts[i + 1] if joined else parts[i])
                i += 1 + joined
            parts = merged
        reached.add(a + b)
    return {t for t, i in vocabulary.items() if i not in {x["id"] for x in spec["added_tokens"]}} == reached


class TokenizerPair:
    """Both tokenizers, the bytes of their tokens, and a store of the pieces met so far."""

    def __init__(self, a_file: bytes, b_file: bytes, by_rank: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        letters = byte_letters()
        names = {i: token for token, i in json.loads(a_file)["model"]["vocab"].items()}
        self.a_bytes = [bytes(letters[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        #: For ASCII pieces, where nothing hangs on the Unicode tables of the libraries.
        self.quick = None
        if by_rank:
            import tiktoken

            ranks = {token: i for i, token in enumerate(self.a_bytes) if token}
            self.quick = tiktoken.Encoding("by-rank", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        #: an id and what follows it: within a group, or at its end
        self.words = [f"{i}{sign}" for n, last in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")) for i in range(n) for sign in (",", last)]
        self.apart = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = [np.empty(0, np.int32), np.empty(0, np.int32)]  # of A and of B, one piece after another
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces, each of which begins with the blank that B adds by itself."""
        parts: tuple[list, list] = ([], [])  # sizes and ids, slice by slice
        for start in range(0, len(pieces), LEARN_PIECES):  # what the libraries return is large
            some = pieces[start : start + LEARN_PIECES]
            if self.quick:
                of_a = [self.quick.encode_ordinary(p) if p.isascii() else None for p in some]
                rest = iter(self.by_library([p for p in some if not p.isascii()]))
                of_a = [next(rest) if ids is None else ids for ids in of_a]
            else:
                of_a = self.by_library(some)
            for side, of in enumerate((of_a, self.b.encode([p[1:] for p in some], num_threads=1))):
                sizes = np.fromiter(map(len, of), np.int64, len(of))
                parts[side].append((sizes, np.fromiter(itertools.chain.from_iterable(of), np.int32, int(sizes.sum()))))
        self.place.update(zip(pieces, range(len(self.place), len(self.place) + len(pieces)), strict=True))
        for side in (0, 1):
            sizes = np.concatenate([s for s, _ in parts[side]])
            self.ends[side] = np.concatenate((self.ends[side], len(self.ids[side]) + np.cumsum(sizes)))
            self.ids[side] = np.concatenate((self.ids[side], *(ids for _, ids in parts[side])))

    def by_library(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B of all texts, one after another, and their numbers by text.

        Empty texts, and texts whose bytes the ids do not give back, have no ids.
        """
        if len(self.place) > STORE_PIECES:
            self.forget()
        split = [(CUT.split(" " + t) if self.apart else [" " + t]) if t else [] for t in texts]
        fresh = list(dict.fromkeys(p for pieces in split for p in pieces if p not in self.place))
        if fresh:
            self.learn(fresh)
        place = np.fromiter(map(self.place.__getitem__, itertools.chain.from_iterable(split)), np.int64)
        by_text = np.concatenate(([0], np.cumsum([len(x) for x in split]))).astype(np.int64)
        ids, bounds = [], []
        for side in (0, 1):
            start, end = self.ends[side][place], self.ends[side][place + 1]
            ends = np.concatenate(([0], np.cumsum(end - start)))
            ids.append(self.ids[side][np.arange(ends[-1]) + np.repeat(start - ends[:-1], end - start)])
            bounds.append(ends[by_text])
        same = np.array([self.gives_back(t, *(i[c[n] : c[n + 1]] for i, c in zip(ids, bounds, strict=True))) for n, t in enumerate(texts)], bool)
        counts = [np.diff(c) for c in bounds]
        if not same.all():
            ids = [i[np.repeat(same, c)] for i, c in zip(ids, counts, strict=True)]
            counts = [np.where(same, c, 0) for c in counts]
        return ids, counts

    def gives_back(self, text: str | None, a: np.ndarray, b: np.ndarray) -> bool:
        """True if the tokens of both sides give back a blank and the text."""
        whole = f" {text}".encode() if text else b""
        return all(b"".join(map(of.__getitem__, ids.tolist())) == whole for of, ids in ((self.a_bytes, a), (self.b_bytes, b)))

    def groups(self, ids: list[np.ndarray], counts: list[np.ndarray]) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text: the ids of each group, in order."""
        (a, b), (at_a, at_b) = ids, shared_ends(self.a_sizes[ids[0]], self.b_sizes[ids[1]])
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[at_a], last_b[at_b] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        marks = np.empty(len(a) + len(b), np.int64)  # A tokens of a group, then its B tokens
        marks[np.arange(len(a)) + np.concatenate(([0], at_b + 1))[group_a]] = 2 * a + last_a
        marks[np.arange(len(b)) + at_a[group_b] + 1] = 2 * (len(self.a_bytes) + b) + last_b
        words = list(map(self.words.__getitem__, marks.tolist()))
        ends = np.cumsum(counts[0] + counts[1]).tolist()
        return ["".join(words[start:end])[:-1] for start, end in zip([0, *ends], ends)]


def shared_ends(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A tokens and of the B tokens that end at the same byte; tokens have at least one byte."""
    _, at_a, at_b = np.intersect1d(np.cumsum(a_sizes), np.cumsum(b_sizes), assume_unique=True, return_indices=True)
    return at_a, at_b


def mixed(keys: np.ndarray, turn: int) -> np.ndarray:
    """64 well mixed bits of each key, other ones for each ``turn``."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (turn + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MinimalHash:
    """Minimal perfect hash of distinct 64-bit keys, with the keys themselves to verify by.

    Level by level, keys that fall on a bit of their own take it; the others try the next
    level. The index of a key is the number of bits set before its bit.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None = None) -> None:
        self.words, self.sizes = words, sizes  # bits of all levels; words of each level
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
        self.keys = keys

    @classmethod
    def of(cls, keys: np.ndarray) -> MinimalHash:
        """The hash of distinct ``keys``."""
        levels, rest = [], keys
        while len(rest):
            words = max(1, (3 * len(rest) // 2 + 63) // 64)
            bit = (mixed(rest, len(levels)) % np.uint64(64 * words)).astype(np.int64)
            alone = np.bincount(bit, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = rest[~alone[bit]]
        made = cls(np.concatenate(levels) if levels else np.empty(0, np.uint64), np.array([len(x) for x in levels], np.int64))
        made.keys = np.empty(len(keys), np.int64)
        made.keys[made.index(keys, verify=False)] = keys
        return made

    def index(self, keys: np.ndarray, verify: bool = True) -> np.ndarray:
        """Index of each key; with ``verify`` -1 for what is not a key."""
        out = np.full(len(keys), -1, np.int64)
        todo, start = np.arange(len(keys)), 0
        for turn, words in enumerate(self.sizes.tolist()):
            if not len(todo):
                break
            bit = mixed(keys[todo], turn) % np.uint64(64 * words)
            word, offset = (bit >> np.uint64(6)).astype(np.int64) + start, bit & np.uint64(63)
            hit = (self.words[word] >> offset) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << offset) - np.uint64(1))
            out[todo[hit]] = self.before[word[hit]] + np.bitwise_count(below[hit])
            todo, start = todo[~hit], start + words
        if verify and len(self.keys):
            out[(out >= 0) & (self.keys[out] != keys)] = -1
        return out

    def columns(self) -> tuple[bytes, bytes, bytes]:
        return packed(self.words, "<u8"), packed(self.sizes), packed(self.keys)

    @classmethod
    def read(cls, words: bytes, sizes: bytes, keys: bytes) -> MinimalHash:
        return cls(unpacked(words, "<u8"), unpacked(sizes), unpacked(keys))


def packed(values: np.ndarray, kind: str = "<i8", steps: bool = False) -> bytes:
    """Compressed bytes of an array; ``steps`` stores what each value adds to the one before it."""
    values = np.diff(values, prepend=0) if steps else values
    return zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def unpacked(data: bytes, kind: str = "<i8", steps: bool = False) -> np.ndarray:
    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)
    return np.cumsum(values) if steps else values


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the B id, the lower half of a key, so that a shard knows all pairs of its B ids."""
    return (mixed(keys & 0xFFFFFFFF, 0) % np.uint64(shards)).astype(np.int64)


def folded(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)


CHUNK_ROW = "a_ids binary, a_counts binary, b_ids binary, b_counts binary, digests array<string>"


class Chunk:
    """The encoded documents of one chunk row, aligned from their ids."""

    def __init__(self, row: dict, a_sizes: np.ndarray, b_sizes: np.ndarray) -> None:
        self.n_a, self.n_b = (unpacked(row[c], "<u4").astype(np.int64) for c in ("a_counts", "b_counts"))
        a, b = (unpacked(row[c], "<u4").astype(np.int64) for c in ("a_ids", "b_ids"))
        # both sides of a document have the same bytes, so ends may run on over the documents
        at_a, at_b = shared_ends(a_sizes[a], b_sizes[b])
        self.links = (a[at_a] << 32) | b[at_b]
        self.n_links = np.diff(np.searchsorted(at_a, np.concatenate(([0], np.cumsum(self.n_a)))))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum by document of a value for each link."""
        ends = np.concatenate(([0], np.cumsum(self.n_links)))
        return np.diff(np.concatenate(([0], np.cumsum(values)))[ends])


def slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += 50 + len(text or "")
        if size >= SLICE_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


class Aligner:
    """The steps of the operator for one pair of tokenizer files."""

    def __init__(self, spark, a_file: bytes, b_file: bytes, shards: int = SHARDS, salts: int = SALTS, chunk_bytes: int = CHUNK_BYTES) -> None:
        ship(spark)
        self.files = spark.sparkContext.broadcast((a_file, b_file))
        self.shards, self.salts, self.chunk_bytes = shards, salts, chunk_bytes
        mark = hashlib.sha256(a_file + b_file).hexdigest()
        files, by_rank = self.files, merges_by_rank(a_file)
        self.pair: Callable[[], TokenizerPair] = lambda: held(("align", mark), lambda: TokenizerPair(*files.value, by_rank))

    def encoded(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """One row for each chunk of documents: its ids by both tokenizers and digests of the groups."""
        pair_of, most = self.pair, self.chunk_bytes
        kind = docs.schema[id_col].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair = pair_of()
            number = TaskContext.get().partitionId() << 36
            docs_in: list[tuple] = []
            id_type, size = pa.int64(), 0

            def give() -> pa.RecordBatch:
                nonlocal docs_in, size, number
                ids, counts, digests = ([], []), ([], []), []
                for texts in slices([t for _, t in docs_in]):
                    some, n = pair.encode(texts)
                    digests += [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in pair.groups(some, n)]
                    for side in (0, 1):
                        ids[side].append(some[side])
                        counts[side].append(n[side])
                ids, counts = ([packed(np.concatenate(x), "<u4") for x in sides] for sides in (ids, counts))
                columns = [
                    pa.array([number], pa.int64()),
                    pa.array([[i for i, _ in docs_in]], pa.list_(id_type)),
                    *(pa.array([x], pa.binary()) for x in (ids[0], counts[0], ids[1], counts[1])),
                    pa.array([digests], pa.list_(pa.string())),
                ]
                number, size, docs_in = number + 1, 0, []
                return pa.RecordBatch.from_arrays(columns, ["chunk", "doc_ids", "a_ids", "a_counts", "b_ids", "b_counts", "digests"])

            for batch in batches:
                id_type = batch.column(0).type
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    text = text.as_py()
                    docs_in.append((doc_id.as_py(), text))
                    size += 50 + len(text or "")
                    if size >= most:
                        yield give()
            if docs_in:
                yield give()
            pair.forget()  # an idle worker holds the vocabularies only

        return docs.select(id_col, text_col).mapInArrow(run, f"chunk bigint, doc_ids array<{kind}>, {CHUNK_ROW}")

    def pairs(self, chunks: DataFrame) -> DataFrame:
        """First pass: ``(chunk, shard, keys, counts)``, the distinct linked pairs of each chunk, dealt by B id."""
        pair_of, shards = self.pair, self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair = pair_of()
            for row in rows_in(batches):
                links = Chunk(row, pair.a_sizes, pair.b_sizes).links
                keys, counts = np.unique(links, return_counts=True)
                of = shard_of(keys, shards)
                some = np.unique(of).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["chunk"]] * len(some), pa.int64()),
                        pa.array(some, pa.int64()),
                        pa.array([packed(keys[of == s], steps=True) for s in some], pa.binary()),
                        pa.array([packed(counts[of == s]) for s in some], pa.binary()),
                    ],
                    ["chunk", "shard", "keys", "counts"],
                )

        return chunks.select("chunk", "a_ids", "a_counts", "b_ids", "b_counts").mapInArrow(
            run, "chunk bigint, shard bigint, keys binary, counts binary"
        )

    def merged_keys(self, pairs: DataFrame, *by: str) -> DataFrame:
        """``(*by, keys)``: distinct keys of all rows that agree in ``by``, of which ``shard`` is the first."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, keys = None, None

            def give() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [*(pa.array([x], pa.int64()) for x in name), pa.array([packed(keys, steps=True)], pa.binary())], [*by, "keys"]
                )

            for row in rows_in(batches):
                mine = unpacked(row["keys"], steps=True)
                here = tuple(row[c] for c in by)
                if here == name:
                    keys = np.union1d(keys, mine)
                else:
                    if name is not None:
                        yield give()
                    name, keys = here, mine
            if name is not None:
                yield give()

        dealt = pairs.select(*by, "keys").repartition(*by).sortWithinPartitions(*by)
        return dealt.mapInArrow(run, ", ".join(f"{c} bigint" for c in by) + ", keys binary")

    def hashes(self, pairs: DataFrame) -> DataFrame:
        """``(shard, words, sizes, keys)``: the minimal perfect hash of the distinct pairs of each shard."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_in(batches):
                words, sizes, keys = MinimalHash.of(unpacked(row["keys"], steps=True)).columns()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]], pa.int64()), *(pa.array([x], pa.binary()) for x in (words, sizes, keys))],
                    ["shard", "words", "sizes", "keys"],
                )

        salted = pairs.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(self.salts)))
        distinct = self.merged_keys(self.merged_keys(salted, "shard", "salt"), "shard")
        return distinct.mapInArrow(run, "shard bigint, words binary, sizes binary, keys binary")

    def met(self, hashes: DataFrame, pairs: DataFrame) -> DataFrame:
        """Rows of a shard and salt together, the hash first: the shard's hash goes to each of its salts."""
        salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(self.salts - 1).cast("bigint")))
        first = hashes.select(*hashes.columns, salts.alias("salt"), F.lit(-1).cast("bigint").alias("chunk"))
        rest = pairs.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(self.salts)))
        both = first.unionByName(rest, allowMissingColumns=True)
        return both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "chunk")

    def counts(self, hashes: DataFrame, pairs: DataFrame) -> DataFrame:
        """``(shard, counts, best)``: dense counts by hash index, and whether they are the highest of their B id."""

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, table, dense = None, None, None

            def give() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([packed(dense)], pa.binary())], ["shard", "counts"])

            for row in rows_in(batches):
                if row["chunk"] == -1:
                    if dense is not None and dense.any():
                        yield give()
                    shard = row["shard"]
                    table = MinimalHash.read(row["words"], row["sizes"], row["keys"])
                    dense = np.zeros(len(table.keys), "<i8")
                else:
                    dense[verified(table, row)] += unpacked(row["counts"])
            if dense is not None and dense.any():
                yield give()

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, dense = None, None

            def give() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([packed(dense)], pa.binary())], ["shard", "counts"])

            for row in rows_in(batches):
                mine = unpacked(row["counts"])
                if row["shard"] == shard:
                    dense = dense + mine
                else:
                    if shard is not None:
                        yield give()
                    shard, dense = row["shard"], mine
            if shard is not None:
                yield give()

        asked = self.met(hashes, pairs).select("shard", "chunk", "words", "sizes", "keys", "counts")
        vectors = asked.mapInArrow(partial, "shard bigint, counts binary")
        return vectors.repartition("shard").sortWithinPartitions("shard").mapInArrow(total, "shard bigint, counts binary")

    def answers(self, hashes: DataFrame, counts: DataFrame, pairs: DataFrame) -> DataFrame:
        """``(chunk, shard, counts, best)``: what each chunk asked for, in the order of its keys."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, dense, best = None, None, None
            for row in rows_in(batches):
                if row["chunk"] == -1:
                    table = MinimalHash.read(row["words"], row["sizes"], row["keys"])
                    dense = unpacked(row["counts"])
                    b_ids, place = np.unique(table.keys & 0xFFFFFFFF, return_inverse=True)
                    highest = np.zeros(len(b_ids), np.int64)
                    np.maximum.at(highest, place, dense)
                    best = dense == highest[place]
                else:
                    at = verified(table, row)
                    columns = [pa.array([x], pa.int64()) for x in (row["chunk"], row["shard"])]
                    columns += [pa.array([x], pa.binary()) for x in (packed(dense[at]), packed(best[at], "u1"))]
                    yield pa.RecordBatch.from_arrays(columns, ["chunk", "shard", "counts", "best"])

        known = hashes.join(counts, "shard")
        asked = self.met(known, pairs.select("chunk", "shard", "keys")).select("chunk", "shard", "words", "sizes", "keys", "counts")
        return asked.mapInArrow(run, "chunk bigint, shard bigint, counts binary, best binary")

    def looked_up(self, chunks: DataFrame, answers: DataFrame) -> DataFrame:
        """Second pass: documents are aligned again and look up the counts of their links."""
        pair_of, shards = self.pair, self.shards
        kind = chunks.schema["doc_ids"].dataType.elementType.simpleString()
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair = pair_of()
            known: list[tuple] = []
            for batch in batches:
                id_type = batch.schema.field("doc_ids").type.value_type
                for row in rows_in([batch]):
                    if row["doc_ids"] is None:
                        known = [x for x in known if x[0] == row["chunk"]]
                        known.append((row["chunk"], row["shard"], unpacked(row["counts"]), unpacked(row["best"], "u1")))
                        continue
                    chunk = Chunk(row, pair.a_sizes, pair.b_sizes)
                    keys, place = np.unique(chunk.links, return_inverse=True)
                    of = shard_of(keys, shards)
                    counts, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
                    for name, shard, some, marks in known:
                        if name == row["chunk"]:
                            counts[of == shard], best[of == shard] = some, marks
                    if len(counts) and counts.min() == 0:
                        raise RuntimeError("a shard has not answered")
                    known, counts, best = [], counts[place], best[place]
                    n = [chunk.n_a, chunk.n_b, chunk.n_links, chunk.n_links, chunk.sums(best), chunk.sums(counts)]
                    columns = [pa.array(row["doc_ids"], id_type), *(pa.array(x.astype(np.int64)) for x in n), pa.array(row["digests"], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names)

        first = answers.withColumn("turn", F.lit(0))
        both = first.unionByName(chunks.withColumn("turn", F.lit(1)), allowMissingColumns=True)
        met = both.repartition("chunk").sortWithinPartitions("chunk", "turn").drop("turn")
        longs = ", ".join(f"{c} bigint" for c in names[1:-1])
        return met.mapInArrow(run, f"doc_id {kind}, {longs}, groups_sha256 string")


def verified(table: MinimalHash, row: dict) -> np.ndarray:
    at = table.index(unpacked(row["keys"], steps=True))
    if len(at) and at.min() < 0:
        raise RuntimeError("a pair is missing in the hash of its shard")
    return at


def align(docs: DataFrame, a_file: bytes, b_file: bytes, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row for each row of ``docs``.

    ``a_file`` is the JSON of a byte-level tokenizer, which encodes a blank and the text;
    ``b_file`` the model of a piece tokenizer, which adds that blank itself. Null and empty
    texts, and texts whose bytes the tokens of either side do not give back, have no tokens:
    zeros and an empty ``groups_sha256``. ``count_sum`` adds up the corpus-wide counts of a
    document's links, ``n_best`` counts the links whose pair is a most frequent one of its
    B id, ties included. Repeated rows give repeated results and count each time; ids may be
    null; other columns are not looked at; an empty table gives no rows.
    ``options``: ``shards`` and ``salts`` spread the work, ``chunk_bytes`` bounds a chunk (a
    longer text is a chunk of its own); none changes the result.
    """
    work = Aligner(docs.sparkSession, a_file, b_file, **options)
    chunks = saved(work.encoded(docs, id_col, text_col), "align-chunks")
    pairs = saved(work.pairs(chunks), "align-pairs")
    hashes = saved(work.hashes(pairs), "align-hashes")
    counts = saved(work.counts(hashes, pairs), "align-counts")
    return work.looked_up(chunks, work.answers(hashes, counts, pairs))


def read_file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()
