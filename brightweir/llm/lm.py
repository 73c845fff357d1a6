"""Language-model scores by prediction by partial matching over bytes.

A text is a sequence of words, each followed by one separator; an end closes it. The
model predicts byte by byte in the longest context it knows, up to ``ORDER`` bytes,
and escapes to the next shorter one. Contexts run on over the separators, back to the one
that opens the text. A block of documents counts its distinct longest grams only,
as all shorter ones are their tails; each distinct gram is scored once for all blocks.

Escape estimation is method D: with T occurrences of Q distinct symbols in a context,
an escape has probability Q/2T and a symbol seen c times (2c-1)/2T. Symbols of the
longer context from which it escaped are excluded: they leave T and Q. What a context
excludes from its parent depends on the context alone and is kept in its trie node.
Below the empty context all symbols not yet seen are equally likely.

The trie is a table, one row for each node, and grows with the corpus. No task holds
all of it: texts are scored in blocks, each joined with the nodes that it asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import saved, ship

ORDER = 5  # bytes of context; a node's path of up to seven bytes fits a key
SYMBOLS = 251  # bytes that are not white space, and the separator
BLOCK_BYTES = 32 << 20  # text of the documents whose words meet in one task
BLOCK_GRAMS = 500_000  # distinct grams scored in one task
SLICE_SYMBOLS = 1 << 19  # symbols of running text laid out at once
LOOSE_GRAMS = 500_000  # grams that wait to be summed with those before them


class Numbering(dict):
    """Word -> its number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def spoken(words: list[bytes]) -> bytes:
    """A text from its opening separator to its end: words, each with its separator, and one more."""
    return b" ".join([b"", *words, b"", b""])


def text_keys(flat: np.ndarray, starts: np.ndarray, order: int) -> Iterator[pa.DictionaryArray]:
    """Longest gram that ends at each symbol, ``SLICE_SYMBOLS`` at once; -1 at opening separators.

    ``flat`` holds texts one after another, which begin at ``starts``.
    """
    padded = np.concatenate((np.zeros(7, np.uint8), flat))
    stops = np.append(starts[1:], len(flat))
    for a in range(0, len(flat), SLICE_SYMBOLS):
        b = min(a + SLICE_SYMBOLS, len(flat))
        # the eight bytes that end at each symbol as one number
        eight = np.ndarray(b - a, ">u8", padded, offset=a, strides=(1,))
        key = eight.astype(np.uint64).view(np.int64)
        key &= (1 << (8 * (order + 1))) - 1
        key |= (order + 1) << 56
        first, last = np.searchsorted(starts, (a - order, b))
        for depth in range(max(order, 1)):  # at the beginning of a text there is less before a symbol
            at = starts[first:last] + depth
            at = at[(at >= a) & (at < np.minimum(stops[first:last], b))] - a
            key[at] = key[at] & ((1 << (8 * (depth + 1))) - 1) | ((depth + 1) << 56) if depth else -1
        yield pa.array(key).dictionary_encode()


def planes(numbers: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones: the high ones are mostly zeros and compress well."""
    return numbers.view(np.uint8).reshape(-1, 4).T.tobytes()


def numbers_of(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their ``n``."""
    if not len(keys):
        return keys, n
    at = np.argsort(keys)
    keys, n = keys[at], n[at]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``, after which Arrow gives back what it holds: an idle worker keeps nothing."""
    yield from batches
    pa.default_memory_pool().release_unused()


class Grams:
    """Distinct longest grams of a block and how often they are in its training texts."""

    def __init__(self, order: int) -> None:
        self.order, self.loose, self.size = order, [], 0
        self.keys = self.n = np.zeros(0, np.int64)

    def add(self, texts: list[bytes], training: bool) -> None:
        if not texts:
            return
        for part in text_keys(*laid_out(texts), self.order):
            found = part.dictionary.to_numpy()
            n = np.bincount(part.indices.to_numpy(), minlength=len(found)) if training else np.zeros(len(found), np.int64)
            self.loose.append((found[found >= 0], n[found >= 0]))
            self.size += len(found)
            # as many wait as are summed, so that a gram is sorted a few times only
            if self.size > max(LOOSE_GRAMS, len(self.keys)):
                self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = zip((self.keys, self.n), *self.loose, strict=True)
        self.loose, self.size = [], 0
        self.keys, self.n = summed(np.concatenate(keys), np.concatenate(n))
        return self.keys, self.n


def tails(keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the grams of ``length`` bytes or more, and the keys of their last ``length`` bytes."""
    at = np.flatnonzero(keys >> 56 >= length)
    return at, (keys[at] & ((1 << (8 * length)) - 1)) | (length << 56)


def tokenised(docs: DataFrame, order: int) -> DataFrame:
    """Rows of three kinds, by block: documents (word numbers), the block's distinct words and
    its distinct longest grams (each with its training count).

    ``docs`` has ``(doc_id, text, held_out)``. A-Z is lower-cased; words are divided by
    the six ASCII white-space characters.
    """
    ship(docs.sparkSession)
    names = ["block", "doc_id", "held_out", "words", "word", "place", "n", "gram"]
    kind = docs.schema["doc_id"].dataType
    schema = f"block bigint, doc_id {kind.simpleString()}, held_out boolean, words binary, word binary, place int, n bigint, gram bigint"
    kinds = [pa.int64(), None, pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24
        seen, block, size = Numbering(), 0, 0
        counts = np.zeros(0, np.int64)
        found = Grams(order)

        def only(**columns: pa.Array) -> pa.RecordBatch:
            size = len(next(iter(columns.values())))
            filled = {"block": pa.array([task + block] * size, pa.int64()), **columns}
            return pa.RecordBatch.from_arrays([filled.get(c, pa.nulls(size, k or ids.type)) for c, k in zip(names, kinds, strict=True)], names)

        def gram_rows() -> Iterator[pa.RecordBatch]:
            keys, n = found.rows()
            for at in range(0, len(keys), 200_000):
                yield only(gram=pa.array(keys[at : at + 200_000]), n=pa.array(n[at : at + 200_000]))

        def add(words: list[np.ndarray]) -> np.ndarray:
            flat = np.concatenate(words) if words else np.zeros(0, np.int32)
            new = np.bincount(flat, minlength=len(seen))
            new[: len(counts)] += counts
            return new

        def dictionary() -> Iterator[pa.RecordBatch]:
            whole = list(seen)
            for at in range(0, len(whole), 50_000):
                some = whole[at : at + 50_000]
                places = np.arange(at, at + len(some), dtype=np.int32)
                yield only(word=pa.array(some, pa.binary()), place=pa.array(places), n=pa.array(counts[at : at + len(some)]))
            yield from gram_rows()

        for batch in batches:
            ids, start, training, out = batch.column(0), 0, [], []
            said: dict[bool, list[bytes]] = {False: [], True: []}
            texts, held = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, text in enumerate(texts):
                line = (text or "").encode().lower()
                words = line.split()
                out.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
                if not held[i]:
                    training.append(out[-1])
                said[bool(held[i])].append(spoken(words))
                size += len(line)
                if size >= BLOCK_BYTES or i == len(texts) - 1:
                    n = i + 1 - start
                    yield only(doc_id=ids.slice(start, n), held_out=batch.column(2).slice(start, n), words=pa.array([planes(w) for w in out], pa.binary()))
                    for held_out, some in said.items():
                        found.add(some, not held_out)
                        some.clear()
                    counts, start, training, out = add(training), i + 1, [], []
                if size >= BLOCK_BYTES:
                    yield from dictionary()
                    seen, block, size, counts = Numbering(), block + 1, 0, np.zeros(0, np.int64)
                    found = Grams(order)
        if seen or found.size or len(found.keys):
            yield from dictionary()

    return docs.select("doc_id", "text", "held_out").mapInArrow(lambda batches: trimmed(run(batches)), schema)


def text_grams(longest: DataFrame, order: int) -> DataFrame:
    """``(key, n)`` of all grams from the longest ones; ``longest`` has ``(gram, n)``.

    Each length is summed before it is cut to the next, so that few rows leave a task.
    """

    def all_tails(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for length in range(order + 1, 0, -1):
            cut_to = (keys & ((1 << (8 * length)) - 1)) | (length << 56)
            keys, n = summed(np.where(keys >> 56 > length, cut_to, keys), n)
            at = np.searchsorted(keys, length << 56)  # the length leads the key
            yield pa.RecordBatch.from_arrays([pa.array(keys[at:]), pa.array(n[at:])], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for batch in batches:
            some.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += len(batch)
            if size >= BLOCK_GRAMS:
                yield from all_tails(*map(np.concatenate, zip(*some, strict=True)))
                some, size = [], 0
        if size:
            yield from all_tails(*map(np.concatenate, zip(*some, strict=True)))

    counts = longest.where("n > 0").mapInArrow(lambda batches: trimmed(run(batches)), "key bigint, n bigint")
    return counts.groupBy("key").agg(F.sum("n").alias("n"))


def linked(nodes: DataFrame) -> DataFrame:
    """``(key, n, t, q, x)``: occurrences of a node, and as a context: its symbols' occurrences,
    their number, and the parent's occurrences of the same symbols, which it excludes on escape."""
    low, length = "(key & 72057594037927935L)", "shiftright(key, 56)"
    deep = nodes.withColumn("above", F.expr(f"shiftleft({length} - 1, 56) | shiftright({low}, 8)")).withColumn(
        "shorter", F.expr(f"shiftleft({length} - 1, 56) | ({low} & (shiftleft(1L, cast(8 * ({length} - 1) as int)) - 1))")
    )
    # written alike in both joins, so that the grams are shuffled by their keys once
    parent = nodes.where("key is not null").select(F.col("key").alias("shorter"), F.col("n").alias("x"))
    inner = (
        deep.join(parent, "shorter", "left")
        .groupBy("above")
        .agg(F.sum("n").alias("t"), F.count("*").alias("q"), F.sum("x").alias("excluded"))
    )
    filled = {"n": "x", "t": "t", "q": "q", "x": "excluded"}
    return parent.join(inner, F.col("shorter") == F.col("above"), "full").select(
        F.coalesce("shorter", "above").alias("key"), *(F.coalesce(c, F.lit(0).cast("bigint")).alias(name) for name, c in filled.items())
    )


def code_lengths(count: int, keys_at, nodes: dict[str, np.ndarray], order: int) -> np.ndarray:
    """log10 probabilities of ``count`` symbols; ``keys_at`` gives, for a length, those with so
    long a gram in reach and its key; ``nodes`` holds ``key`` (ascending), ``n``, ``t``, ``q``, ``x``."""
    known, n, t, q, x = (nodes[c] for c in ("key", "n", "t", "q", "x"))

    def find(keys: np.ndarray) -> np.ndarray:
        """Index of each key, that of an empty node where there is none."""
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        return np.where(known[at] == keys, at, len(known)) if len(known) else np.zeros(len(keys), np.int64)

    n, t, q, x = (np.append(a, 0) for a in (n, t, q, x))
    code, done = np.zeros(count), np.zeros(count, bool)
    origin = np.full(count, len(known))  # node of the context it escaped from
    for length in range(order + 1, 0, -1):
        at, keys = keys_at(length)
        left = ~done[at]
        at, keys = at[left], keys[left]
        body = keys & ((1 << 56) - 1)
        context = find(np.where(length > 1, (np.int64(length - 1) << 56) | (body >> 8), 0))
        total, kinds = t[context] - x[origin[at]], q[context] - q[origin[at]]
        seen = np.where(t[context] > 0, n[find(keys)], 0)
        whole = 2.0 * total
        choice = np.where(seen > 0, 2 * seen - 1, kinds)
        counts = (t[context] > 0) & (whole > 0) & (choice > 0)
        code[at[counts]] += np.log10(choice[counts] / whole[counts])
        done[at[seen > 0]] = True
        origin[at] = np.where(t[context] > 0, context, origin[at])
    root = find(np.zeros(1, np.int64))
    code[~done] -= np.log10(max(1, SYMBOLS - q[root][0]))
    return code


def gram_blocks(longest: DataFrame, order: int) -> DataFrame:
    """Rows of two kinds, by block: ``gram`` to be scored, and ``key`` of the nodes that its block asks for.

    Grams with equal endings meet in one block, so that few blocks ask for the same node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, some, size = TaskContext.get().partitionId() << 24, [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(some)
            wanted, ends = [np.zeros(1, np.int64)], keys
            for length in range(order + 1, 0, -1):
                ends = np.unique(np.where(ends >> 56 > length, (ends & ((1 << (8 * length)) - 1)) | (length << 56), ends))
                whole = ends[np.searchsorted(ends, length << 56) :]
                wanted.append(whole)
                if length > 1:
                    wanted.append(((whole & ((1 << 56) - 1)) >> 8) | ((length - 1) << 56))
            asked = np.unique(np.concatenate(wanted))
            for column, name in ((keys, "gram"), (asked, "key")):
                for at in range(0, len(column), 200_000):
                    part = pa.array(column[at : at + 200_000])
                    pair = [part, pa.nulls(len(part), pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), *(pair if name == "gram" else pair[::-1])], ["block", "gram", "key"])

        for batch in batches:
            some.append(batch.column(0).to_numpy())
            size += len(some[-1])
            if size >= BLOCK_GRAMS:
                yield from rows()
                block, some, size = block + 1, [], 0
        if size:
            yield from rows()

    ending = F.reverse(F.lpad(F.hex("gram"), 16, "0"))
    return longest.select("gram").repartitionByRange(ending).mapInArrow(lambda batches: trimmed(run(batches)), "block bigint, gram bigint, key bigint")


def gram_scores(longest: DataFrame, nodes: DataFrame, order: int) -> DataFrame:
    """``(gram, logp)`` of distinct longest grams: the code length of the last byte after the others."""
    blocks = saved(gram_blocks(longest, order), "ppm-blocks")
    asked = blocks.where("key is not null").select("block", "key").join(nodes, "key").withColumnRenamed("block", "of_block")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = np.argsort(right["key"].to_numpy())
        found = {c: right[c].to_numpy()[at] for c in ("key", "n", "t", "q", "x")}
        keys = left["gram"].to_numpy()
        return pa.table({"gram": keys, "logp": code_lengths(len(keys), lambda length: tails(keys, length), found, order)})

    return (
        blocks.where("gram is not null").select("block", "gram").groupBy("block")
        .cogroup(asked.groupBy("of_block"))
        .applyInArrow(run, "gram bigint, logp double")
    )


def text_log_probabilities(texts: list[bytes], grams: np.ndarray, logp: np.ndarray, order: int) -> np.ndarray:
    """log10 of each text's probability; ``grams`` (ascending) holds all their longest grams."""
    flat, starts = laid_out(texts)
    code, at = np.zeros(len(flat)), 0
    for part in text_keys(flat, starts, order):
        keys = part.dictionary.to_numpy()
        each = np.where(keys < 0, 0.0, logp[np.minimum(np.searchsorted(grams, keys), len(grams) - 1)])
        code[at : at + len(part)] = each[part.indices.to_numpy()]
        at += len(part)
    return np.add.reduceat(code, starts)


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``.

    ``docs`` has ``(doc_id, text, held_out)``; rows with ``held_out`` false train the
    model, all are scored. ``base_score`` is the smoothed unigram model over words and
    the end, ``score`` the code length of the same sequence under the trie, both log10.
    Null and empty texts are an end alone; a null ``held_out`` counts as false; repeated
    rows train repeatedly and give repeated results; ids pass through; a word may be as
    long as the text. Without training rows every symbol is equally likely.
    """
    if not 0 <= order <= 6:
        raise ValueError("a key holds contexts of up to six bytes")
    parts = saved(tokenised(docs.withColumn("held_out", F.coalesce("held_out", F.lit(False))), order), "lm-blocks")
    rows = parts.where("words is not null")
    ends = rows.where("not held_out").count()
    found = parts.where("word is not null")
    words = found.groupBy("word").agg(F.sum("n").alias("n"))
    end = docs.sparkSession.range(1).select(F.lit(b"").alias("word"), F.lit(ends).cast("bigint").alias("n"))
    words = saved(words.unionByName(end), "lm-words")
    size = words.agg(F.sum("n").alias("tokens"), F.sum((F.col("n") > 0).cast("bigint")).alias("kinds")).first()
    tokens, kinds = size["tokens"], size["kinds"]
    held = parts.where("gram is not null")
    longest = saved(held.groupBy("gram").agg(F.sum("n").alias("n")), "ppm-longest")
    nodes = saved(linked(saved(text_grams(longest, order), "ppm-grams")), "ppm-trie")
    scored = saved(gram_scores(longest, nodes, order), "ppm-scored")
    # one narrow table of both: a word has a place and its count, a gram its key and its code length
    spelt = found.select("block", "place", "word").join(words, "word").select(F.col("block").alias("of_block"), "place", "word", F.col("n").alias("value"))
    coded = held.select("block", "gram").join(scored, "gram").select(F.col("block").alias("of_block"), F.col("gram").alias("value"), "logp")
    entries = spelt.unionByName(coded, allowMissingColumns=True)
    smooth = np.log10(tokens + 0.5 * (kinds + 1))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        is_word = pc.is_valid(right["place"])
        given = right.select(["place", "value", "word"]).filter(is_word)
        right = right.select(["value", "logp"]).filter(pc.invert(is_word))
        grams, codes = right["value"].to_numpy(), right["logp"].to_numpy()
        del right
        order_of = np.argsort(grams)
        grams, codes = grams[order_of], codes[order_of]
        del order_of
        at = given["place"].to_numpy()
        n, texts = np.zeros(len(at), np.int64), np.empty(len(at), object)
        n[at], texts[at] = given["value"].to_numpy(), given["word"].to_numpy()
        base = np.log10(n + 0.5) - smooth
        sums, totals, waiting, length = [], [], [], 0
        for words in left["words"]:
            here = numbers_of(words.as_py())
            sums.append((len(here) + 1, int((n[here] > 0).sum()) + (ends > 0), base[here].sum()))
            waiting.append(spoken(texts[here].tolist()))
            length += len(waiting[-1])
            if length >= SLICE_SYMBOLS:
                totals.append(text_log_probabilities(waiting, grams, codes, order))
                waiting, length = [], 0
        if waiting:
            totals.append(text_log_probabilities(waiting, grams, codes, order))
        tokens_in, known_in, base_sum = zip(*sums, strict=True) if sums else ((), (), ())
        done = pa.table(
            {
                "doc_id": left["doc_id"],
                "held_out": left["held_out"],
                "n_tokens": pa.array(tokens_in, pa.int64()),
                "n_known": pa.array(known_in, pa.int64()),
                "train_tokens": pa.array([tokens] * len(sums), pa.int64()),
                "base_score": pa.array(np.array(base_sum) + np.log10(ends + 0.5) - smooth),
                "score": pa.array(np.concatenate(totals) if totals else np.zeros(0)),
            }
        )
        pa.default_memory_pool().release_unused()
        return done

    return (
        rows.select("block", "doc_id", "held_out", "words").groupBy("block")
        .cogroup(entries.groupBy("of_block"))
        .applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    )
