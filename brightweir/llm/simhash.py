"""SimHash fingerprints and groups of near copies by deletion-variant signatures.

A fingerprint has 64 bits. For up to four differing bits it is cut into three
segments (21, 21, 22 bits), fewer than the five that exact matching needs: one
segment then differs by at most one bit, and all variants of a segment that leave
one bit out meet in an equality join. Two refinements keep the buckets small without
losing a pair:

* Some segment is equal. The other 42 or 43 bits differ by at most four, so of five
  pieces of them one is equal: key = whole segment + piece (3 x 5 keys).
* No segment is equal. Then two of three differ by exactly one bit, so there is a
  segment that does and whose successor (cyclic) does: key = the segment without one
  bit + one half of its successor, which is equal in one of the halves (64 x 2 keys).

Every pair within four bits shares one of the 143 keys, of about 30 bits each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.graph import connected_components
from ..operators.overlap import union_all
from ..runtime import cut
from .common import saved, ship

SEED = 42
MAX_BITS = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit, width
PIECES = 5
HOT = 500  # members of a bucket that are compared as they are
#: Bits set in each byte value: row b has its eight bits, lowest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
BYTE_PLACE = (256 * np.arange(8)).astype(np.int64)


def shingles(text: bytes, words: int) -> list[bytes]:
    """Runs of ``words`` words, joined by spaces, repeats included.

    A-Z is lower-cased; words are divided by the six ASCII white-space characters.
    Fewer words give the whole sequence, no words give no shingle.
    """
    parts = text.lower().split()
    if not parts:
        return []
    line = b" ".join(parts)
    if len(parts) <= words:
        return [line]
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = len(parts) - words + 1
    return [line[a:b] for a, b in zip(starts[:last].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(features: list[bytes], seed: int = SEED) -> int:
    """Bit b is 1 if it is set in more than half of the features' XXH64 values."""
    values = [xxhash.xxh64_intdigest(f, seed) for f in features]
    if not values:
        return 0
    columns = np.array(values, dtype="<u8").view(np.uint8).reshape(-1, 8) + BYTE_PLACE
    counts = np.bincount(columns.ravel(), minlength=2048).reshape(8, 256) @ BYTE_BITS
    bits = (2 * counts.ravel() > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text", seeds: tuple[int, ...] = (SEED,)
) -> DataFrame:
    """``(doc_id, fps)``, one row for each row of ``docs``: a fingerprint for each seed; a null text counts as empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).cast(pa.large_binary()):
                features = shingles(text.as_py() or b"", words)
                found.append([fingerprint(features, seed) for seed in seeds])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "fps"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fps array<bigint>")


def variant_keys(fps: np.ndarray) -> np.ndarray:
    """The 143 keys of each fingerprint, as an array of one row for each."""
    fps = fps.astype(np.uint64)
    parts = [(fps >> np.uint64(at)) & np.uint64((1 << width) - 1) for at, width in SEGMENTS]
    keys: list[np.ndarray] = []

    def add(rest: np.ndarray) -> None:
        keys.append(rest | np.uint64(len(keys) << 48))

    for s, (_, width) in enumerate(SEGMENTS):
        nxt, last = (s + 1) % 3, (s + 2) % 3
        other = parts[nxt] | (parts[last] << np.uint64(SEGMENTS[nxt][1]))
        cuts = np.linspace(0, 64 - width, PIECES + 1).astype(int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            add((parts[s] << np.uint64(16)) | ((other >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)))
        half = SEGMENTS[nxt][1] // 2
        halves = (parts[nxt] & np.uint64((1 << half) - 1), parts[nxt] >> np.uint64(half))
        for bit in range(width):
            left = parts[s] & np.uint64(~(1 << bit) & 0xFFFFFFFF)
            for h in halves:
                add((left << np.uint64(16)) | h)
    return np.stack(keys, axis=1).astype(np.int64)


def index_rows(fps: DataFrame, kind: int = 0) -> DataFrame:
    """``(key, fp)`` for every key of every distinct fingerprint; those of another ``kind`` have other keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy()
            for start in range(0, len(whole), 2000):
                some = whole[start : start + 2000]
                keys = variant_keys(some) | (kind << 56)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(some, keys.shape[1]))], ["key", "fp"]
                )

    return fps.select("fp").mapInArrow(run, "key bigint, fp bigint")


def differing(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def open_buckets(members: DataFrame, key: str) -> DataFrame:
    """Names of the buckets that hold several components."""
    return members.groupBy(key).agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select(key)


def finer_buckets(members: DataFrame) -> DataFrame:
    """``(bucket, fp, part)``: buckets of more than ``HOT`` members dealt anew by five pieces of the bits.

    Two members within four bits agree in one piece, so every link stays in some bucket.
    Pieces take every fifth bit, in the next turns every fifth bit of what is left, so that
    the bits all members share lie in all pieces alike. Hashed names may put two buckets
    together; members are compared anyway.
    """
    members = members.select("bucket", "fp", "part")
    for step in (1, 5, 25):
        hot = cut(members.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("bucket"))
        if hot.isEmpty():
            break
        masks = [sum(1 << i for i in range(64) if i // step % 5 == piece) for piece in range(5)]
        pieces = [F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint") for m in masks]
        names = F.array(*(F.xxhash64("bucket", F.lit(n), F.col("fp").bitwiseAND(m)) for n, m in enumerate(pieces)))
        dealt = saved(members.join(hot, "bucket", "left_semi").select(F.explode(names).alias("bucket"), "fp", "part"), "simhash-dealt")
        finer = dealt.join(open_buckets(dealt, "bucket"), "bucket", "left_semi")
        members = saved(members.join(hot, "bucket", "left_anti").unionByName(finer), "simhash-finer")
    return members


def shared_buckets(fps: DataFrame, kind: int = 0) -> DataFrame:
    """``(key, fp, before, lowest)``: fingerprints that share a key, with their neighbour and the smallest one."""
    by_key = Window.partitionBy("key").orderBy("fp")
    shared = index_rows(fps, kind).select(
        "key",
        "fp",
        F.lag("fp").over(by_key).alias("before"),
        F.lead("fp").over(by_key).alias("after"),
        F.first("fp").over(by_key).alias("lowest"),
    )
    shared = shared.where(F.col("before").isNotNull() | F.col("after").isNotNull())
    return saved(shared.select("key", "fp", "before", "lowest"), "simhash-buckets")


def linked_components(fps: DataFrame, max_bits: int = MAX_BITS, kinds: int = 1) -> DataFrame:
    """``(fp, component)`` of distinct fingerprints linked when at most ``max_bits`` differ.

    Buckets are never paired up as a whole. First every member is compared with the
    smallest member of its bucket and with its neighbour in order; of all its buckets one
    near one of either kind is kept, which ties dense groups together with two rows for
    each fingerprint. Then only buckets that still hold several components compare members
    across components, large ones after they are dealt anew by ``finer_buckets``.

    With ``kinds`` above 1 a column ``kind`` counts from 0, and only fingerprints of one kind meet.
    Their keys are sorted kind by kind, so no more of them are on disk at once; all else is one
    job for all kinds. A fingerprint that several kinds hold is one all the same.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the segments prove links of at most {MAX_BITS} bits")
    shared = shared_buckets(fps) if kinds == 1 else union_all([shared_buckets(fps.where(F.col("kind") == i), i) for i in range(kinds)])
    fps = fps if kinds == 1 else fps.select("fp").distinct()
    # of all keys of a fingerprint one near neighbour and one near smallest member tie it in
    ties = [F.min(F.when(differing("fp", c) <= max_bits, F.col(c))).alias(c) for c in ("before", "lowest")]
    tied = saved(shared.where(F.col("before").isNotNull()).groupBy("fp").agg(*ties), "simhash-tied")
    near = tied.select("before", "fp").union(tied.select("lowest", "fp")).toDF("src", "dst").where("src is not null").distinct()
    first = saved(connected_components(saved(near, "simhash-links")), "simhash-first")
    members = shared.join(first.withColumnRenamed("id", "fp"), "fp", "left").select(
        "key", "fp", F.coalesce("component", "fp").alias("part")
    )
    members = saved(members, "simhash-members")
    rest = saved(members.join(open_buckets(members, "key"), "key", "left_semi"), "simhash-open")
    rest = finer_buckets(rest.withColumnRenamed("key", "bucket"))
    one, two = rest.toDF("key", "fp1", "part1"), rest.toDF("key2", "fp2", "part2")
    bridges = (
        one.join(two, (F.col("key") == F.col("key2")) & (F.col("part1") < F.col("part2")) & (differing("fp1", "fp2") <= max_bits))
        .select(F.col("part1").alias("src"), F.col("part2").alias("dst"))
        .distinct()
    )
    merged = connected_components(saved(bridges, "simhash-bridges"))
    parts = fps.select("fp").join(first.select(F.col("id").alias("fp"), F.col("component").alias("part")), "fp", "left").select(
        "fp", F.coalesce("part", "fp").alias("part")
    )
    return parts.join(merged.select(F.col("id").alias("part"), "component"), "part", "left").select(
        "fp", F.coalesce("component", "part").alias("component")
    )


def simhash_components(
    docs: DataFrame, words: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the smallest id that
    links of at most ``max_bits`` differing bits reach. Null and empty texts have the
    fingerprint zero and are linked like any other. Repeated rows give repeated
    results; a null id is kept and is never the smallest while another id is there.
    An empty table gives no rows; other columns of ``docs`` are not looked at.
    """
    marks = fingerprints(docs, words, id_col, text_col).select("doc_id", F.get("fps", F.lit(0)).alias("fp"))
    marks = saved(marks, "simhash-marks")
    lowest = saved(marks.groupBy("fp").agg(F.min("doc_id").alias("lowest")), "simhash-distinct")
    parts = linked_components(lowest, max_bits).join(lowest, "fp")
    parts = saved(parts, "simhash-parts")
    names = parts.groupBy("component").agg(F.min("lowest").alias("component_id"))
    by_fp = parts.join(names, "component").select(F.col("fp").alias("mark"), "component_id")
    return marks.join(by_fp, marks["fp"] == by_fp["mark"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def word_marks(docs: DataFrame, id_col: str, text_col: str, seeds: tuple[int, ...]) -> DataFrame:
    """``(doc_id, node, fps)``: 128 bits of the sequence of words, and fingerprints of the distinct words."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found = [], []
            for text in batch.column(1).cast(pa.large_binary()):
                words = (text.as_py() or b"").lower().split()
                nodes.append(xxhash.xxh3_128_hexdigest(b" ".join(words)))
                distinct = list(set(words))
                found.append([fingerprint(distinct, seed) for seed in seeds])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.string()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "node", "fps"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, node string, fps array<bigint>")


def shingle_sets(docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """``(node, n, grams)``: hashes of the distinct shingles of each text and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                text = text.as_py() or b""
                grams = np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in shingles(text, words)], np.uint64)).view(np.int64)
                node = xxhash.xxh3_128_hexdigest(b" ".join(text.lower().split()))
                column = pa.ListArray.from_arrays(pa.array([0, len(grams)], pa.int32()), pa.array(grams))
                yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([len(grams)], pa.int32()), column], ["node", "n", "grams"])

    return docs.select(text_col).mapInArrow(run, "node string, n int, grams array<bigint>")


def sharing_buckets(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``members`` of clusters dealt to the shingles by which similar ones must meet, the marks of a node put together.

    Of two sets of similarity s, each holds s of the other's size in common: ordered by how many
    sets hold them, rare ones first, they share one of the first ``n - ceil(s n) + 1`` shingles
    of either. Shingles that a single set holds come before all others and are only counted, so a
    set with more of them than it can spare has no partner and goes. No link is lost. Their number
    comes out as ``alone``: the text that many copies were made of has fewest, and is a pivot first.
    """
    ids = saved(members.select("node").distinct().withColumn("no", F.monotonically_increasing_id()), "near-ids")
    grams = sets.join(ids, "node").select("no", "n", F.explode("grams").alias("gram"))
    held = grams.groupBy("gram").agg(F.count("*").alias("held")).where("held > 1")
    known = grams.join(held, "gram").groupBy("no", "n").agg(F.sort_array(F.collect_list(F.struct("held", "gram"))).alias("known"))
    # a little less than s n, as the product may come out above a whole number
    first = (F.size("known") - F.ceil(similarity * F.col("n") - 1e-6) + 1).cast("int")
    meeting = known.where(first > 0).select("no", (F.col("n") - F.size("known")).alias("alone"), F.explode(F.slice("known", 1, first)).alias("place"))
    meeting = saved(meeting.select("no", "alone", "place.gram"), "near-meeting")
    # of shingles that the same nodes meet by, told by 128 bits and their number, one is enough
    holders = F.sum(F.xxhash64("no", F.lit(1)).cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("no", F.lit(2))).alias("b")
    same = meeting.groupBy("gram").agg(F.count("*").alias("many"), *holders).where("many > 1")
    chosen = same.groupBy("many", "a", "b").agg(F.min("gram").alias("gram")).select("gram")
    buckets = meeting.join(chosen, "gram", "left_semi").join(ids, "no").select("node", "alone", "gram")
    whole = members.groupBy("node", "lowest", "part").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    dealt = saved(whole.join(buckets, "node").withColumnRenamed("gram", "cluster").select(members.columns), "near-dealt")
    return saved(dealt.join(open_buckets(dealt, "cluster"), "cluster", "left_semi").select(members.columns), "near-sharing")


def verified_links(clusters: DataFrame, sets: DataFrame, similarity: float, reach: int) -> list[DataFrame]:
    """Tables ``(src, dst)`` of nodes of a cluster whose sets of shingles are as similar as asked.

    ``clusters`` is ``(cluster, node, lowest, fp)``. In each turn the first nodes of every cluster
    are its pivots and compared with all nodes that are not yet joined to them and differ in at
    most ``reach`` bits; then they leave the cluster. A linked node stays, as it may be similar to
    others than its pivot, so any two similar nodes of a cluster that are in reach end in one
    component of the links. A cluster ends when one component is left, and joined nodes are not
    compared, so of dense ones only pairs with nodes outside the largest component are. Clusters of similar texts end after the first turn. What is left of the others is dealt anew
    by ``sharing_buckets``, so that from then on a pivot meets only nodes with which it shares a
    rare shingle. There the texts with the fewest shingles of their own come first, so copies
    that are like their original but not each other end in one turn. A turn takes eight times
    as many pivots as the one before.
    Sizes bound the similarity, so of a pivot no more is moved than of the nodes it meets.
    """
    links, pivots, dealt = [], 1, False
    order = Window.partitionBy("cluster").orderBy("alone", "held", "lowest", "node")
    columns = ["cluster", "node", "lowest", "marks", "alone", "part"]
    marks = F.array(F.struct("cluster", "fp")).alias("marks")
    open_nodes = clusters.select("cluster", "node", "lowest", marks, F.lit(0).alias("alone"), F.col("node").alias("part"))
    near = F.exists("marks", lambda a: F.exists("marks2", lambda b: (a["cluster"] == b["cluster"]) & (F.bit_count(a["fp"].bitwiseXOR(b["fp"])) <= reach)))
    while not open_nodes.isEmpty():
        held = open_nodes.groupBy("cluster", "part").agg(F.count("*").alias("held"))
        numbered = saved(open_nodes.join(held, ["cluster", "part"]).withColumn("at", F.row_number().over(order)).drop("held"), "near-numbered")
        first = numbered.where(F.col("at") <= pivots).toDF(*(c if c == "cluster" else f"{c}2" for c in numbered.columns))
        later = F.struct("lowest2", "node2") < F.struct("lowest", "node")
        apart = (F.col("part") != F.col("part2")) & (F.col("at2") < F.col("at"))
        met = (
            numbered.join(first, "cluster")
            .where(apart & near)
            .select(*(F.when(later, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in (("node", "node2", "src"), ("node2", "node", "dst"))))
            .distinct()
        )
        size = sets.select("node", "n")
        sized = met.join(size.toDF("src", "n1"), "src").join(size.toDF("dst", "n2"), "dst")
        sized = saved(sized.where(F.least("n1", "n2") >= similarity * F.greatest("n1", "n2")), "near-met")
        grams = sets.select("node", "grams")
        both = sized.join(grams.toDF("dst", "g2"), "dst").join(grams.toDF("src", "g1"), "src")
        shared = F.size(F.array_intersect("g1", "g2"))
        # whole numbers: shared / (n1 + n2 - shared) >= similarity, without a quotient
        alike = both.withColumn("shared", shared).where(F.col("shared") >= similarity * (F.col("n1") + F.col("n2") - F.col("shared")))
        links.append(saved(alike.select("src", "dst"), "near-links"))
        rest = numbered.where(F.col("at") > pivots).select(columns)
        # pivots that left still join the parts of the nodes they were linked to
        parts = numbered.select("node", "part").distinct()
        ties = links[-1].join(parts.toDF("src", "part1"), "src").join(parts.toDF("dst", "part2"), "dst").select(F.col("part1").alias("src"), F.col("part2").alias("dst")).distinct()
        joined = connected_components(ties).toDF("part", "whole")
        rest = rest.join(joined, "part", "left").select(*columns[:-1], F.coalesce("whole", "part").alias("part"))
        rest = saved(rest, "near-joined")
        open_nodes = saved(rest.join(open_buckets(rest, "cluster"), "cluster", "left_semi").select(columns), "near-rest")
        if dealt:
            pivots *= 8
        else:
            open_nodes, dealt = sharing_buckets(open_nodes, sets, similarity), True
    return links


def near_groups(
    docs: DataFrame,
    max_bits: int = MAX_BITS,
    seeds: tuple[int, ...] = (SEED, SEED + 1, SEED + 2, SEED + 3, SEED + 4),
    words: int = 5,
    similarity: float = 0.8,
    reach: int = 12,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, group_id)``: documents joined by links of verified similarity.

    Fingerprints of the distinct words, one for each seed, propose clusters: those whose
    fingerprints links of ``max_bits`` bits connect. Within a cluster, ``verified_links``
    compares the sets of shingles of ``words`` words (the whole text if it is shorter).
    Texts of the same words in the same order are one node from the start. Two documents
    within ``max_bits`` in some fingerprint and as similar as asked are in one group; and
    every document of a group of several is as similar to another of them.
    Groups are named by their smallest id. Null and empty texts form one group. Rows with
    a null id are left out; an id that several rows bear may be in several groups.
    """
    docs = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col)
    marks = saved(word_marks(docs, id_col, text_col, seeds), "near-marks")
    nodes = saved(marks.groupBy("node", "fps").agg(F.min("doc_id").alias("lowest")), "near-nodes")
    # a mask for each seed keeps equal bits of two seeds apart and leaves the differing bits within one
    masks = F.array(*(F.lit(0).cast("bigint") if i == 0 else F.xxhash64(F.lit(i)) for i in range(len(seeds))))
    masked = F.zip_with("fps", masks, lambda fp, mask: fp.bitwiseXOR(mask))
    placed = saved(nodes.select("node", "lowest", F.posexplode(masked).alias("kind", "fp")), "near-placed")
    fps = placed.select("kind", "fp").distinct()
    parts = linked_components(fps, max_bits, len(seeds))
    placed = saved(placed.join(parts, "fp").select("kind", "component", "node", "lowest", "fp"), "near-parts")
    several = placed.groupBy("kind", "component").agg(F.count("*").alias("n")).where("n > 1").select("kind", "component")
    name = F.xxhash64("kind", "component").alias("cluster")
    proposed = placed.join(several, ["kind", "component"], "left_semi").select(name, "node", "lowest", "fp")
    proposed = saved(proposed, "near-clusters")
    met = proposed.select("node").distinct()
    ids = nodes.join(met, "node", "left_semi").select(F.col("lowest").alias(id_col)).distinct()
    sets = shingle_sets(docs.join(ids, id_col, "left_semi"), text_col, words)
    sets = saved(sets.join(met, "node", "left_semi").dropDuplicates(["node"]), "near-sets")
    edges = None
    for found in verified_links(proposed, sets, similarity, reach):
        edges = found if edges is None else edges.unionByName(found)
    named = nodes.select("node", "lowest", F.col("node").alias("component"))
    if edges is not None:
        groups = connected_components(saved(edges, "near-edges")).withColumnRenamed("id", "node")
        named = nodes.join(groups, "node", "left").select("node", "lowest", F.coalesce("component", "node").alias("component"))
    named = saved(named, "near-named")
    lowest = named.groupBy("component").agg(F.min("lowest").alias("group_id"))
    by_node = named.join(lowest, "component").select("node", "group_id")
    return marks.join(by_node, "node").select("doc_id", "group_id")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of ``near_groups``, that of the smallest id.

    All columns are kept. Rows with a null id stay, as nothing could name them; rows
    that repeat an id stay or go together, and go if one of them does.
    """
    id_col = options.get("id_col", "doc_id")
    gone = near_groups(docs, **options).where("doc_id <> group_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(saved(gone, "near-gone"), id_col, "left_anti").select(docs.columns)
