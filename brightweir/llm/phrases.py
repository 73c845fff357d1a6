"""Phrase collocations from a weighted de Bruijn graph of word grams, by language.

A text is cut into pieces and words. Each position gives its longest gram, up to four
words. Four-word grams are the edges of a graph whose nodes are three-word grams that
overlap in two; an edge weighs the number of its occurrences. A position too close to the
end of its piece gives a shorter gram, a *correction*. Counts of shorter phrases need no
further pass: a node's flow is the weight of its outgoing edges plus the corrections that
end there, and so on down to single words.

* **Pruning.** A first pass adds up words and word pairs in a table of fixed size by hash,
  counts capped where they are frequent enough, a second one grams of three and four words
  that the first does not rule out. What shares a slot below the support is
  rare for certain, so positions stop before it, and the flow that leaves the graph there
  is a correction like that of a piece end. Only exact counts decide later; a full table
  prunes less and changes nothing.
* **Compaction.** Nodes with one edge in and one out, of the same weight as their flow,
  are passed through by every occurrence. Runs of edges over such nodes become one path
  (pointer doubling): a passage that many documents share is one row and not one for each
  word. The three-word grams inside a path stand in a longer phrase of equal count, so
  they are dropped without being scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import cut
from .common import saved, ship

LONGEST = 4
SLOT_BITS = 24  # of the pruning table: 16 MB in a task, 2 MB as bits
BLOCK_SLOTS = 1 << 18
SUM_SALTS = 8
MOST_WORDS = 1_000_000  # a worker remembers before it starts afresh
PATH_EDGES = 1_000  # edges of a path in one row
RANK_SALTS = 32
#: A-Z to lower case, piece ends to ".", tabs to blanks.
LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")


class Words(dict):
    """Words of one language to numbers; 0 is the end of a piece."""

    def __init__(self, lang: str) -> None:
        super().__init__()
        self.seed = xxhash.xxh64_intdigest(lang.encode())
        self.names: list[bytes] = []
        self.hashed = np.zeros(0, np.uint64)
        self[b"."]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.names.append(word)
        return number

    def numbers(self, texts: list[str]) -> np.ndarray:
        """All words of the texts in order, with a 0 after each piece."""
        stream = b"".join([t.encode() + b"." for t in texts]).translate(LETTERS).replace(b".", b" . ").split()
        return np.fromiter(map(self.__getitem__, stream), np.int64, len(stream))

    def hashes(self) -> np.ndarray:
        if len(self.hashed) < len(self.names):
            fresh = [xxhash.xxh64_intdigest(w, self.seed) for w in self.names[len(self.hashed) :]]
            self.hashed = np.concatenate((self.hashed, np.array(fresh, np.uint64)))
        return self.hashed


def slots(hashes: np.ndarray, numbers: np.ndarray, sizes: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """Slots of the grams of the given sizes that begin at each place."""
    of = hashes[numbers]
    gram, out = of, []
    for size in range(1, max(sizes) + 1):
        if size > 1:
            gram = (gram * np.uint64(0x9E3779B97F4A7C15)) ^ np.roll(of, 1 - size)
        if size in sizes:
            out.append(((gram * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)).astype(np.int64))
    return out


def ahead(flags: np.ndarray, step: int = 1) -> np.ndarray:
    """The flag ``step`` places further on, false behind the end."""
    return np.append(flags[step:], np.zeros(min(step, len(flags)), bool))


def likely_grams(words: Words, numbers: np.ndarray, likely: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """For sizes 1 to 4, where a gram begins that the passes so far do not rule out."""
    real = numbers > 0
    one = real
    if not likely:
        two = real & ahead(real)
        return [one, two]
    first, second = slots(words.hashes(), numbers, (1, 2), bits)
    two = real & ahead(real) & likely[0][second]
    one = real & (likely[0][first] | two)
    three = two & ahead(two)
    if len(likely) > 1:
        third, fourth = slots(words.hashes(), numbers, (3, 4), bits)
        three &= likely[1][third]
        return [one, two, three, three & ahead(three) & likely[1][fourth]]
    return [one, two, three, three & ahead(three)]


def by_language(batch: pa.RecordBatch, vocabularies: dict[str, Words]) -> Iterator[tuple[str, Words, np.ndarray]]:
    texts: dict[str, list[str]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if text:
            texts.setdefault("und" if lang is None else lang, []).append(text)
    if sum(map(len, vocabularies.values())) > MOST_WORDS:
        vocabularies.clear()
    for lang, some in texts.items():
        words = vocabularies.setdefault(lang, Words(lang))
        yield lang, words, words.numbers(some)


def packed(table: np.ndarray) -> bytes:
    return pa.compress(table.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), np.uint8)


def frequent_slots(docs: DataFrame, min_count: int, bits: int, known: list[np.ndarray]) -> np.ndarray:
    """Bits of the slots whose grams together reach ``min_count``: ``2 ** bits / 8`` bytes, whatever the input.

    Without ``known`` bits, slots of words and word pairs; with those, of three and four words
    whose pairs they do not rule out.
    """
    least, size = min(min_count, 255), 1 << bits
    block = min(size, BLOCK_SLOTS)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    sizes = (3, 4) if known else (1, 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely = [np.unpackbits(x).view(bool) for x in shared.value]
        table = np.zeros(size, np.uint8)
        vocabularies: dict[str, Words] = {}
        for batch in batches:
            for _, words, numbers in by_language(batch, vocabularies):
                at = likely_grams(words, numbers, likely, bits)[-2:]
                of = slots(words.hashes(), numbers, sizes, bits)
                slot, n = np.unique(np.concatenate([s[w] for s, w in zip(of, at, strict=True)]), return_counts=True)
                table[slot] = np.minimum(table[slot] + n, least)
        some = [i for i in range(0, size, block) if table[i : i + block].any()]
        if some:
            salt = TaskContext.get().partitionId() % SUM_SALTS
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int64()), pa.array([salt] * len(some), pa.int64()), pa.array([packed(table[i : i + block]) for i in some], pa.binary())],
                ["start", "salt", "counts"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, table = None, None

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*(pa.array([x], pa.int64()) for x in name), pa.array([packed(table)], pa.binary())], ["start", "salt", "counts"]
            )

        for batch in batches:
            for start, salt, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = unpacked(data, block)
                if (start, salt) == name:
                    table = np.minimum(table.astype(np.uint16) + mine, least).astype(np.uint8)
                else:
                    if name is not None:
                        yield give()
                    name, table = (start, salt), mine
        if name is not None:
            yield give()

    schema = "start bigint, salt bigint, counts binary"
    tables = docs.mapInArrow(count, schema)
    for fold in (F.col("salt"), F.lit(0).cast("bigint").alias("salt")):
        dealt = tables.select("start", fold, "counts").repartition("start", "salt").sortWithinPartitions("start", "salt")
        tables = saved(dealt.mapInArrow(add, schema), "phrase-slots")
    found = np.zeros(size, bool)
    for start, data in tables.select("start", "counts").toLocalIterator():  # at most size / block rows
        found[start : start + block] = unpacked(bytes(data), block) >= least
    return np.packbits(found)


def longest_grams(docs: DataFrame, known: list[np.ndarray], bits: int) -> DataFrame:
    """``(lang, gram, size, cnt)``: the longest grams of all positions, added up by batch; size 0 counts all words."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely = [np.unpackbits(x).view(bool) for x in shared.value]
        vocabularies: dict[str, Words] = {}
        for batch in batches:
            langs, grams, sizes, counts = [], [], [], []
            for lang, words, numbers in by_language(batch, vocabularies):
                reach = np.sum(likely_grams(words, numbers, likely, bits), axis=0)
                found = [((b"",), 0, int((numbers > 0).sum()))]
                names = words.names
                for size in range(1, LONGEST + 1):
                    at = np.flatnonzero(reach == size)
                    key, first = numbers[at], at
                    for step in range(1, size):  # numbers of the distinct grams so far, then one word more
                        _, first_place, key = np.unique(key, return_index=True, return_inverse=True)
                        key = (key << 32) | numbers[at + step]
                    _, first, n = np.unique(key, return_index=True, return_counts=True)
                    columns = [[names[i] for i in numbers[at[first] + step].tolist()] for step in range(size)]
                    found += [(g, size, c) for g, c in zip(zip(*columns, strict=True), n.tolist(), strict=True)]
                langs += [lang] * len(found)
                grams += [b" ".join(g).decode() for g, _, _ in found]
                sizes += [s for _, s, _ in found]
                counts += [c for _, _, c in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())],
                ["lang", "gram", "size", "cnt"],
            )

    return docs.mapInArrow(run, "lang string, gram string, size int, cnt bigint")


def first_words(gram: str, n) -> F.Column:
    return F.substring_index(gram, " ", n) if isinstance(n, int) else F.expr(f"substring_index({gram}, ' ', {n})")


def flows(grams: DataFrame) -> DataFrame:
    """``(lang, gram, size, cnt)``: exact counts of all grams met, from the longest down.

    What flows through a node is what its outgoing edges carry and what ends there.
    """
    level = grams.where(F.col("size") == LONGEST).select("lang", "gram", "cnt")
    levels = [level.withColumn("size", F.lit(LONGEST))]
    for size in range(LONGEST - 1, 0, -1):
        through = level.select("lang", first_words("gram", size).alias("gram"), "cnt")
        ends = grams.where(F.col("size") == size).select("lang", "gram", "cnt")
        level = through.unionByName(ends).groupBy("lang", "gram").agg(F.sum("cnt").alias("cnt"))
        level = saved(level, "phrase-flow") if size > 1 else level
        levels.append(level.withColumn("size", F.lit(size)))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def through_nodes(phrases: DataFrame) -> DataFrame:
    """``(lang, gram, before, after, cnt)``: nodes that one edge enters, one leaves, and all flow passes."""
    edges = phrases.where(F.col("size") == LONGEST)
    no = F.lit(None).cast("string")
    sides = edges.select("lang", first_words("gram", LONGEST - 1).alias("gram"), no.alias("before"), F.col("gram").alias("after"), "cnt").union(
        edges.select("lang", first_words("gram", 1 - LONGEST).alias("gram"), F.col("gram").alias("before"), no.alias("after"), "cnt")
    )
    nodes = sides.groupBy("lang", "gram").agg(
        F.count("before").alias("n_in"),
        F.count("after").alias("n_out"),
        F.max("before").alias("before"),
        F.max("after").alias("after"),
        F.min("cnt").alias("low"),
        F.max("cnt").alias("high"),
    )
    flow = phrases.where(F.col("size") == LONGEST - 1).select("lang", "gram", "cnt")
    return (
        nodes.where("n_in = 1 and n_out = 1 and low = high and before <> after")
        .join(flow, ["lang", "gram"])
        .where("cnt = low")
        .select("lang", "gram", "before", "after", "cnt")
    )


def edge_places(nodes: DataFrame) -> DataFrame:
    """``(lang, gram, start, hops)`` of the edges next to ``nodes``: the first edge of their path and the way to it.

    Flow is conserved and every piece begins somewhere, so paths never close to a ring and
    doubling the pointers ends after the logarithm of the longest path.
    """
    back = nodes.select("lang", F.col("after").alias("gram"), F.col("before").alias("start"), F.lit(1).cast("bigint").alias("hops"))
    heads = nodes.select("lang", F.col("before").alias("gram")).join(back, ["lang", "gram"], "left_anti")
    state = cut(back.unionByName(heads.select("lang", "gram", F.col("gram").alias("start"), F.lit(0).cast("bigint").alias("hops"))))
    while True:
        further = state.select("lang", F.col("gram").alias("start"), F.col("start").alias("next"), F.col("hops").alias("more"))
        state = cut(state.join(further, ["lang", "start"]).select("lang", "gram", F.col("next").alias("start"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("more") > 0).alias("moved")))
        if state.where("moved").isEmpty():
            return state.drop("moved")
        state = state.drop("moved")


def repeated_paths(phrases: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(lang, start, piece, words, cnt)``: compacted paths, their words in rows of at most ``PATH_EDGES`` edges.

    ``start`` is the first gram; the words of the pieces 0, 1, 2, ... put together follow it.
    """
    places = edge_places(nodes)
    weights = phrases.where(F.col("size") == LONGEST).select("lang", "gram", "cnt")
    steps = places.join(weights, ["lang", "gram"]).withColumn("piece", F.floor(F.col("hops") / PATH_EDGES).cast("bigint"))
    word = F.struct("hops", first_words("gram", -1).alias("word"))
    return (
        steps.groupBy("lang", "start", "piece")
        .agg(F.array_sort(F.collect_list(F.when(F.col("hops") > 0, word))).alias("steps"), F.max("cnt").alias("cnt"))
        .select("lang", "start", "piece", F.concat_ws(" ", "steps.word").alias("words"), "cnt")
    )


def expanded(paths: DataFrame) -> DataFrame:
    """The three-word grams inside compacted paths, ``(lang, gram)``, from the paths alone."""
    width = LONGEST - 1
    head = F.when(F.col("piece") == 0, F.col("start"))
    # a piece begins with the last words before it, which its predecessor ends with
    before = F.lag("words").over(Window.partitionBy("lang", "start").orderBy("piece"))
    tail = F.expr(f"substring_index(before, ' ', -{width})")
    whole = F.split(F.concat_ws(" ", F.coalesce(head, tail), F.nullif("words", F.lit(""))), " ")
    words = paths.withColumn("before", before).select("lang", "piece", whole.alias("w"))
    # piece 0 begins with a node that the path enters by, every path ends with one it leaves by
    first = F.when(F.col("piece") == 0, F.lit(2)).otherwise(F.lit(1))
    places = F.sequence(first, F.size("w") - width)
    grams = F.transform(places, lambda i: F.concat_ws(" ", F.slice("w", i, width)))
    return words.where(F.size("w") - width >= first).select("lang", F.explode(grams).alias("gram"))


def subsumed(phrases: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``(lang, gram)`` of phrases inside a longer one that has at least ``share`` of their count."""
    part, whole = share
    parts = [
        first_words("gram", size) if start == 0 else F.expr(f"substring_index(substring_index(gram, ' ', {start + size}), ' ', -{size})")
        for size in (2, 3)
        for start in range(LONGEST - size + 1)
    ]
    shapes = [(size, start) for size in (2, 3) for start in range(LONGEST - size + 1)]
    inside = F.array_compact(F.array(*(F.when(F.col("size") >= F.lit(max(start + size, size + 1)), p) for (size, start), p in zip(shapes, parts, strict=True))))
    longer = phrases.where("size > 2").select("lang", F.explode(inside).alias("gram"), "cnt")
    highest = longer.groupBy("lang", "gram").agg(F.max("cnt").alias("longest"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return (
        phrases.where("size > 1")
        .join(highest, ["lang", "gram"])
        .where(F.lit(whole).cast("decimal(10,0)") * wide("longest") >= F.lit(part).cast("decimal(10,0)") * wide("cnt"))
        .select("lang", "gram")
    )


def scored(candidates: DataFrame, phrases: DataFrame, scale: int) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` by the lowest-scoring cut, ties to the first one."""
    counts = phrases.where(F.col("size") < LONGEST).select("lang", "gram", "cnt")
    cuts = candidates.select(
        "lang", F.col("gram").alias("phrase"), F.col("cnt").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size"
    ).select("lang", "phrase", "a", "k", first_words("phrase", "k").alias("left"), first_words("phrase", "k - size").alias("right"))
    of_left = counts.toDF("lang", "left", "l")
    of_right = counts.toDF("lang", "right", "r")
    ratio = F.expr(f"(cast({scale} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.join(of_left, ["lang", "left"]).join(of_right, ["lang", "right"]).select("lang", "phrase", "a", F.struct(ratio.alias("score"), "k", "l", "r").alias("cut"))
    return best.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score"
    )


def phrase_counts(docs: DataFrame, min_count: int, lang_col: str = "lang", text_col: str = "text", bits: int = SLOT_BITS) -> tuple[DataFrame, DataFrame]:
    """``(lang, gram, size, cnt)`` of all phrases of one to four words with at least ``min_count`` occurrences, and ``(lang, n)``."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    known: list[np.ndarray] = []
    for _ in range(2):
        known.append(frequent_slots(docs, min_count, bits, list(known)))
    grams = saved(longest_grams(docs, known, bits).groupBy("lang", "gram", "size").agg(F.sum("cnt").alias("cnt")), "phrase-grams")
    totals = grams.where("size = 0").select("lang", F.col("cnt").alias("n"))
    return saved(flows(grams.where("size > 0")).where(F.col("cnt") >= min_count), "phrases"), totals


def collocations(
    docs: DataFrame,
    min_count: int = 30,
    per_lang: int = 2_000,
    scale: int = 2_000_000,
    share: tuple[int, int] = (80, 100),
    lang_col: str = "lang",
    text_col: str = "text",
    bits: int = SLOT_BITS,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of two to four words of each language.

    Counts go over whole texts, overlaps included; phrases do not reach over the ends of
    pieces. A null language counts as ``und``, a null text as empty; texts without words
    add nothing; repeated rows count each time; a language without frequent phrases has no
    rows, an empty table none at all. Ties of scores go to the higher count, then to the
    smaller phrase in byte order, so ranks are unique. Products are taken in decimals of 38
    digits, and the pruning table (``bits``) changes no result. Other columns are not looked at.
    """
    phrases, totals = phrase_counts(docs, min_count, lang_col, text_col, bits)
    nodes = cut(through_nodes(phrases))
    paths = saved(repeated_paths(phrases, nodes), "phrase-paths")
    inner = expanded(paths)  # the longer phrase there has the same count
    outer = phrases.join(inner.distinct(), ["lang", "gram"], "left_anti")
    gone = subsumed(phrases, share)
    candidates = cut(outer.where("size > 1").join(gone, ["lang", "gram"], "left_anti"))
    found = scored(candidates, phrases, scale).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= per_lang)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= per_lang)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


CHECK = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i:i+3])) AS g FROM words),
totals AS (SELECT lang, count(*) AS n FROM grams GROUP BY lang),
f AS MATERIALIZED (
    SELECT lang, array_to_string(g[1:k], ' ') AS phrase, k AS size, count(*) AS f
    FROM grams, (VALUES (1), (2), (3), (4)) s(k) WHERE len(g) >= k GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
sub AS (SELECT lang, array_to_string(w[i:i+m-1], ' ') AS phrase, max(a) AS longest
        FROM cand, (VALUES (1), (2), (3)) p(i), (VALUES (2), (3)) q(m)
        WHERE m < size AND i + m - 1 <= size GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN sub s ON s.lang = c.lang AND s.phrase = c.phrase
         WHERE s.longest IS NULL OR 100::HUGEINT * s.longest < 80::HUGEINT * c.a),
cuts AS (SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
         FROM kept c JOIN (VALUES (1), (2), (3)) s(k) ON k < c.size
         JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
         JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k+1:c.size], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS rn FROM cuts),
ranked AS (SELECT lang, phrase, a, l, r, score,
                  row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE rn = 1)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
