"""Exact groups of equal texts: Patricia tries decide who owns a text.

Texts count as equal when nothing but the six ASCII white-space characters tells them
apart. Three steps:

* Each task folds its rows by chunks: equal texts of a chunk become one *part*, a row
  with the text, the number of rows and the best of them. So a text that a third of all
  rows bear is sent on once for each chunk, not once for each row.
* Parts are dealt by length and content hash. A task inserts the whole byte strings of
  its parts into one compressed radix trie; equal strings, and only those, meet in a
  terminal node, which keeps the smallest identifier and the parts seen. Nothing is
  decided by the hash: texts of equal hash and length still part in the trie.
* A trie that outgrows its bound gives up its heaviest subtree: what it holds, and what
  comes for it later, leaves the task as rows for another round, dealt anew. A round ends
  at least one text of each task, so the rounds end.

Rows learn their owner by a join on the part, which no more rows than a chunk holds share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import saved, ship

WHITE = b" \t\n\x0b\x0c\r"
CHUNK_BYTES, CHUNK_ROWS = 16 << 20, 20_000
TRIE_BYTES = 96 << 20  # of text that a task holds
NODE_BYTES = 300  # what a node and its terminal cost besides
ROW_PARTS = 10_000  # parts of a row that leaves a trie

TEXT_HASH = xxhash.xxh64_intdigest


class Node:
    """The edge ``text[start:end]`` that leads here, the nodes below by first byte, and the terminal."""

    __slots__ = ("text", "start", "end", "below", "owner", "rows", "parts", "key", "gone")

    def __init__(self, text: bytes, start: int, end: int) -> None:
        self.text, self.start, self.end = text, start, end
        self.below: dict[int, Node] = {}
        self.owner = None  # smallest identifier of the text that ends here
        self.rows = 0
        self.parts: list[int] = []
        self.key = None
        self.gone = False  # given up with all below; stays as a stub


def common_length(a: bytes, at_a: int, b: bytes, at_b: int, most: int) -> int:
    """Number of equal bytes of ``a`` from ``at_a`` and ``b`` from ``at_b``, at most ``most``, by halving."""
    if a[at_a : at_a + most] == b[at_b : at_b + most]:
        return most
    low, high = 0, most  # the first low bytes are equal, the first high ones are not
    while high - low > 1:
        middle = (low + high) // 2
        if a[at_a + low : at_a + middle] == b[at_b + low : at_b + middle]:
            low = middle
        else:
            high = middle
    return low


class OwnerTrie:
    """Compressed radix trie of whole byte strings whose terminals keep the smallest identifier."""

    def __init__(self, most_bytes: int) -> None:
        self.root = Node(b"", 0, 0)
        self.most, self.held, self.texts = most_bytes, 0, 0

    def insert(self, text: bytes, key: object, owner: tuple, rows: int, parts: list[int]) -> list[tuple]:
        """Add a row; returns the rows ``(text, key, owner, rows, parts)`` that had to leave."""
        node, at = self.root, 0
        while at < len(text):
            if node.gone:
                return [(text, key, owner, rows, parts)]
            child = node.below.get(text[at])
            if child is None:
                child = Node(text, at, len(text))
                node.below[text[at]] = child
                node, at = child, len(text)
                break
            size = child.end - child.start
            same = common_length(text, at, child.text, child.start, min(size, len(text) - at))
            if same < size:  # the edge is cut in two
                middle = Node(child.text, child.start, child.start + same)
                child.start += same
                middle.below[child.text[child.start]] = child
                node.below[text[at]] = middle
                child = middle
            node, at = child, at + same
        if node.gone:
            return [(text, key, owner, rows, parts)]
        if node.owner is None:
            node.owner, node.key = owner, key
            self.held += len(text) + NODE_BYTES
            self.texts += 1
        elif owner < node.owner:
            node.owner = owner
        node.rows += rows
        node.parts += parts
        self.held += 8 * len(parts)
        return self.spill() if self.held > self.most and self.texts > 1 else []

    def spill(self) -> list[tuple]:
        """Give up the heaviest subtree that leaves something behind."""
        weights: dict[int, int] = {}
        order, stack = [], [(self.root, 0)]
        while stack:
            node, depth = stack.pop()
            order.append((node, depth + node.end - node.start))
            stack += [(child, depth + node.end - node.start) for child in node.below.values()]
        for node, depth in reversed(order):
            own = depth + NODE_BYTES + 8 * len(node.parts) if node.owner is not None else 0
            weights[id(node)] = own + sum(weights[id(child)] for child in node.below.values())
        node, depth = self.root, 0
        while node.below:
            child = max(node.below.values(), key=lambda n: weights[id(n)])
            node, depth = child, depth + child.end - child.start
            if 2 * weights[id(node)] <= self.held or node.owner is not None or len(node.below) != 1:
                if weights[id(node)] < self.held:
                    break
        left = []
        stack = [(node, depth)]
        while stack:
            gone, reach = stack.pop()
            if gone.owner is not None:
                # a node's text passes through it: its first ``reach`` bytes are the path
                text = gone.text[:reach]
                for start in range(0, len(gone.parts), ROW_PARTS):
                    some = gone.parts[start : start + ROW_PARTS]
                    left.append((text, gone.key, gone.owner, gone.rows if start == 0 else 0, some))
                self.held -= reach + NODE_BYTES + 8 * len(gone.parts)
                self.texts -= 1
            stack += [(child, reach + child.end - child.start) for child in gone.below.values()]
        node.below, node.owner, node.rows, node.parts = {}, None, 0, []
        node.gone = True
        return left

    def owners(self) -> Iterator[tuple[tuple, int, list[int]]]:
        """``(owner, rows, parts)`` of every text that stayed."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.owner is not None:
                yield node.owner, node.rows, node.parts
            stack += node.below.values()


def folded(docs: DataFrame, id_col: str, text_col: str, text_hash: Callable[[bytes], int], chunk_rows: int) -> DataFrame:
    """Every row with its part; the best row of a part also bears the part's text and size."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        following = task.partitionId() << 36
        ids, texts, chars, size = [], [], [], 0
        id_type = pa.int64()

        def give() -> pa.RecordBatch:
            nonlocal following
            best: dict[bytes, int] = {}
            count: dict[bytes, int] = {}
            for i, text in enumerate(texts):
                j = best.setdefault(text, i)
                count[text] = count.get(text, 0) + 1
                if (-chars[i], ids[i] is None, ids[i]) < (-chars[j], ids[j] is None, ids[j]):
                    best[text] = i
            number = {text: following + n for n, text in enumerate(best)}
            following += len(number)
            digests = {text: hashlib.sha256(text).digest() for text in best}
            leads = [best[text] == i for i, text in enumerate(texts)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, id_type),
                    pa.array([number[t] for t in texts], pa.int64()),
                    pa.array(leads, pa.bool_()),
                    pa.array([digests[t] for t in texts], pa.binary()),
                    pa.array(chars, pa.int64()),
                    pa.array([count[t] if x else None for t, x in zip(texts, leads, strict=True)], pa.int64()),
                    pa.array([len(t) if x else None for t, x in zip(texts, leads, strict=True)], pa.int64()),
                    pa.array([signed(text_hash(t)) if x else None for t, x in zip(texts, leads, strict=True)], pa.int64()),
                    pa.array([t if x else None for t, x in zip(texts, leads, strict=True)], pa.binary()),
                ],
                ["doc_id", "part", "leads", "digest", "n_chars", "n_rows", "length", "hash", "body"],
            )

        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = (text or "").encode().translate(None, WHITE)
                ids.append(doc_id)
                texts.append(body)
                chars.append(len(text or ""))
                size += len(body)
                if size >= CHUNK_BYTES or len(ids) >= chunk_rows:
                    yield give()
                    ids, texts, chars, size = [], [], [], 0
        if ids:
            yield give()

    return docs.select(id_col, text_col).mapInArrow(
        run,
        f"doc_id {kind}, part bigint, leads boolean, digest binary, n_chars bigint, n_rows bigint, length bigint, hash bigint, body binary",
    )


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def owned(parts: DataFrame, most_bytes: int) -> DataFrame:
    """One round of tries over rows ``(length, hash, body, n_chars, doc_id, keep_part, n_rows, parts)``.

    Rows with a null body are results, ``(parts, doc_id, keep_part, n_rows)``; the others left a
    trie that was full and go to another round.
    """
    kind = parts.schema["doc_id"].dataType.simpleString()
    names = ["length", "hash", "body", "n_chars", "doc_id", "keep_part", "n_rows", "parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = OwnerTrie(most_bytes)
        id_type = None

        def rows_out(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), id_type, pa.int64(), pa.int64(), pa.list_(pa.int64())]
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            id_type = batch.column(4).type
            out = []
            for length, mark, body, chars, doc_id, keep, n, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left = trie.insert(body, (length, mark), (-chars, doc_id is None, doc_id, keep), n, members)
                out += [(*key, text, -best[0], best[2], best[3], rows, some) for text, key, best, rows, some in left]
            if out:
                yield rows_out(out)
        some, members = [], 0
        for best, rows, of in trie.owners():
            for start in range(0, len(of), ROW_PARTS):
                some.append((None, None, None, None, best[2], best[3], rows, of[start : start + ROW_PARTS]))
                members += min(ROW_PARTS, len(of) - start)
            if members >= ROW_PARTS:
                yield rows_out(some)
                some, members = [], 0
        if some:
            yield rows_out(some)

    return parts.select(*names).mapInArrow(
        run,
        f"length bigint, hash bigint, body binary, n_chars bigint, doc_id {kind}, keep_part bigint, n_rows bigint, parts array<bigint>",
    )


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    text_hash: Callable[[bytes], int] = TEXT_HASH,
    most_bytes: int = TRIE_BYTES,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row for each row of ``docs``.

    Of equal texts the row with the most code points in the original text stays, then
    that of the smallest id (a null id comes last); of rows that agree in all of that one
    stays. A null text counts as empty, and texts of white space only equal it. Repeated
    rows give repeated results, of which one is kept. ``text_sha256`` is that of the text
    without white space. An empty table gives no rows; other columns are not looked at.
    Texts of any length are compared whole. ``most_bytes`` bounds the text a trie holds,
    ``chunk_rows`` the rows that one part stands for; neither changes the result.
    """
    ship(docs.sparkSession)
    rows = saved(folded(docs, id_col, text_col, text_hash, chunk_rows), "exact-rows")
    parts = rows.where("leads").select(
        "length", "hash", "body", "n_chars", "doc_id", F.col("part").alias("keep_part"), "n_rows", F.array("part").alias("parts")
    )
    results = None
    turn = 0
    while True:
        done = saved(owned(parts.repartition(F.lit(turn), "length", "hash"), most_bytes), "exact-owners")
        ended = done.where("body is null").select("doc_id", "keep_part", "n_rows", "parts")
        results = ended if results is None else results.unionByName(ended)
        parts = done.where("body is not null")
        turn += 1
        if parts.isEmpty():
            break
    owners = results.select(
        F.explode("parts").alias("part"), F.col("doc_id").alias("keep_id"), "keep_part", F.col("n_rows").alias("group_size")
    )
    return rows.select("doc_id", "part", "leads", "digest").join(owners, "part").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("leads") & (F.col("part") == F.col("keep_part"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are not kept; rows are told apart by id, so ids must not repeat. Null ids stay."""
    gone = exact_groups(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_col))
    return docs.join(saved(gone, "exact-gone"), id_col, "left_anti")


CHECK = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
r AS (SELECT doc_id, body, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
             row_number() OVER w = 1 AS kept
      FROM t WINDOW w AS (PARTITION BY body ORDER BY n_chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, sha256(body) AS text_sha256 FROM r
"""
