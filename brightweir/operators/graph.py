"""Co-occurrence graph, label propagation, components, betweenness, community splitting.

Edges are undirected rows ``(src, dst)`` with ``src < dst``. Loops run one Spark job
per level and cut their lineage in the shared checkpoint folder; the driver only
reads single numbers (a maximum, a count, a modularity).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut, new_dir
from .overlap import HEAVY, overlap_pairs, union_all
from .relational import chunked_sets, dense_index, running_totals, symmetric, vertices_of

CUT_EVERY = 4
WIDTH = 16  # roots of a block: with 64 the generated code of the sums takes longer to compile than it saves
BLOCKS_AT_ONCE = 4_096
WIDE = "decimal(38,0)"


def cooccurrence_edges(pairs: DataFrame, threshold: int, heavy: int = HEAVY) -> DataFrame:
    """Users joined when they share at least ``threshold`` distinct items.

    Column 0 is the user, column 1 the item. Users below the threshold on their own
    are dropped before pairing.
    """
    user, item = pairs.columns[:2]
    rows = pairs.select(F.col(user).alias("id"), F.col(item).alias("member")).distinct()
    return overlap_pairs(rows, threshold, heavy).select(
        F.col("id1").alias("src"), F.col("id2").alias("dst"), "shared"
    )


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``(id, label)`` after synchronous rounds of taking the most frequent neighbour label.

    Ties go to the smallest label. Votes are counted before they are compared, so a
    hub's neighbours never meet as single rows.
    """
    both = cut(symmetric(edges))
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for done in range(1, rounds + 1):
        votes = (
            both.join(labels, both["src"] == labels["id"])
            .groupBy("dst", "label")
            .agg(F.count("*").alias("votes"))
        )
        best = F.min(F.struct((-F.col("votes")).alias("neg"), "label"))
        labels = votes.groupBy(F.col("dst").alias("id")).agg(best.alias("best")).select(
            "id", F.col("best.label").alias("label")
        )
        if done % CUT_EVERY == 0 and done < rounds:
            labels = cut(labels)
    return labels


def community_members(labels: DataFrame) -> DataFrame:
    """``(community, id, size)``; a community is named by its smallest member."""
    named = labels.groupBy("label").agg(F.min("id").alias("community"), F.count("*").alias("size"))
    return labels.join(named, "label").select("community", "id", "size")


def communities(labels: DataFrame, chunk_size: int = 10000) -> DataFrame:
    """``(community, size, chunk, members)``; small communities have one chunk."""
    members = community_members(labels)
    return chunked_sets(members.select("community", "id"), "community", "id", chunk_size).select(
        "community", F.col("n_items").alias("size"), "chunk", F.col("items").alias("members")
    )


def numbered_roots(roots: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """``(id, block, bit)``: every root is one of the ``WIDTH`` bits of a block.

    ``order(id, place)`` puts roots of equal place next to each other, so that blocks of a
    graph with many components cover few of them.
    """
    if order is None:
        named = dense_index(roots, "id")
    else:
        key = F.struct("place", "id").alias("key")
        named = dense_index(roots.join(order, "id").select(key), "key").select(F.col("key.id").alias("id"), "idx")
    return named.select("id", F.floor(F.col("idx") / WIDTH).alias("block"), (F.col("idx") % WIDTH).cast("int").alias("bit"))


def bit(i: int) -> Column:
    return F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")


def lane_sums(name: str) -> list[Column]:
    return [F.sum(F.get(name, F.lit(i))).alias(f"{name}{i}") for i in range(WIDTH)]


def bfs_waves(both: DataFrame, numbered: DataFrame, most: int | None = None) -> list[DataFrame]:
    """One table ``(block, node, mask, sigma)`` per distance, ``WIDTH`` roots in a row.

    ``both`` has every edge in both directions. Bit i of ``mask`` says that the node has
    this distance from root i of the block, ``sigma[i]`` how many shortest paths lead there.
    Edges are walked once for each block, not for each root, and what was reached before
    is told by bits: a neighbour of distance d lies at d-1, d or d+1, so a new wave only
    has to be compared with the last two.
    """
    own = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.when(i == F.col("bit"), 1.0).otherwise(0.0))
    masks = F.when(F.col("bit") == 63, bit(63)).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit")))
    # roots of a block are different nodes, so the first wave has one row for each
    waves = [cut(numbered.select("block", F.col("id").alias("node"), masks.alias("mask"), own.alias("sigma")))]
    while most is None or len(waves) <= most:
        moved = waves[-1].join(both, F.col("node") == both["src"]).select("block", F.col("dst").alias("node"), "sigma", F.lit(0).cast("bigint").alias("seen"))
        for old in waves[-2:]:
            moved = moved.unionByName(old.select("block", "node", F.lit(None).cast("array<double>").alias("sigma"), F.col("mask").alias("seen")))
        reached = moved.groupBy("block", "node").agg(*lane_sums("sigma"), F.bit_or("seen").alias("seen"))
        fresh = F.array(
            *(F.when(F.col("seen").bitwiseAND(bit(i)) == 0, F.coalesce(f"sigma{i}", F.lit(0.0))).otherwise(0.0) for i in range(WIDTH))
        )
        mask = reduce(Column.bitwiseOR, (F.when(F.get("sigma", F.lit(i)) > 0, bit(i)).otherwise(F.lit(0).cast("bigint")) for i in range(WIDTH)))
        wave = cut(reached.select("block", "node", fresh.alias("sigma")).select("block", "node", mask.alias("mask"), "sigma").where("mask <> 0"))
        if most is None and wave.isEmpty():
            break
        waves.append(wave)
    return waves


def bfs_levels(edges: DataFrame, roots: DataFrame | None = None, most: int | None = None) -> list[DataFrame]:
    """One table ``(root, node, sigma)`` per distance, up to ``most``; sigma counts shortest paths."""
    numbered = cut(numbered_roots(vertices_of(edges) if roots is None else roots))
    waves = bfs_waves(cut(symmetric(edges)), numbered, most)
    names = numbered.select("block", "bit", F.col("id").alias("root"))
    return [
        wave.select("block", "node", F.posexplode("sigma").alias("bit", "sigma")).where("sigma > 0").join(names, ["block", "bit"]).select("root", "node", "sigma")
        for wave in waves
    ]


def bfs_all(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``(root, node, level, sigma)`` for every root and every node it reaches."""
    levels = bfs_levels(edges, roots)
    return union_all([level.withColumn("level", F.lit(i)) for i, level in enumerate(levels)]).select("root", "node", "level", "sigma")


def edge_betweenness(edges: DataFrame, roots: DataFrame | None = None, order: DataFrame | None = None, at_once: int = BLOCKS_AT_ONCE) -> DataFrame:
    """``(src, dst, betweenness)``: shortest-path credit of each edge over all roots, halved.

    Credit flows from the deepest level up: a node passes ``sigma_p / sigma_n`` of one
    plus what it received to each predecessor p. Blocks of roots are keys of one job a
    level. Only beyond ``at_once`` blocks (65,536 roots) are they taken in turns whose
    credits add up, which bounds the state to that many roots times the nodes they reach.
    """
    both = cut(symmetric(edges))
    numbered = cut(numbered_roots(vertices_of(edges) if roots is None else roots, order))
    turns = numbered.select(F.floor(F.col("block") / at_once)).distinct().count()
    flows = []
    for turn in range(turns):
        some = numbered if turns == 1 else numbered.where(F.floor(F.col("block") / at_once) == turn)
        part = path_credits(both, some)
        flows += [part if turns == 1 else cut(part)] if part is not None else []
    if not flows:
        return edges.select("src", "dst", F.lit(0.0).alias("betweenness"))
    return union_all(flows).groupBy("src", "dst").agg((F.sum("credit") / 2).alias("betweenness"))


def path_credits(both: DataFrame, numbered: DataFrame) -> DataFrame | None:
    """Credits ``(src, dst, credit)`` of the paths from the roots, or nothing if there are no edges.

    With ``rate = (1 + received) / sigma`` of a node, each predecessor gets its own sigma
    times the rate; so rates are summed over the children first and meet the sigma of the
    predecessor once.
    """
    waves = bfs_waves(both, numbered)
    if len(waves) == 1:
        return None
    nodes = waves[-1].select("block", "node", "sigma", F.array_repeat(F.lit(0.0), WIDTH).alias("received"))
    rates = []
    for depth in range(len(waves) - 1, 0, -1):
        rate = F.array(
            *(
                F.when(F.get("sigma", F.lit(i)) > 0, (1 + F.get("received", F.lit(i))) / F.get("sigma", F.lit(i))).otherwise(0.0)
                for i in range(WIDTH)
            )
        )
        rates.append(cut(nodes.select("block", F.lit(depth).alias("depth"), "node", rate.alias("rate"))))
        if depth > 1:
            passed = (
                rates[-1]
                .join(both, F.col("node") == both["src"])
                .select("block", F.col("dst").alias("node"), "rate")
                .groupBy("block", "node")
                .agg(*lane_sums("rate"))
            )
            got = F.array(*(F.get("sigma", F.lit(i)) * F.coalesce(f"rate{i}", F.lit(0.0)) for i in range(WIDTH)))
            nodes = waves[depth - 1].join(passed, ["block", "node"], "left").select("block", "node", "sigma", got.alias("received"))
    parents = union_all([wave.select("block", F.lit(i + 1).alias("depth"), F.col("node").alias("parent"), "sigma") for i, wave in enumerate(waves[:-1])])
    credit = reduce(Column.__add__, (F.get("sigma", F.lit(i)) * F.get("rate", F.lit(i)) for i in range(WIDTH)))
    flow = (
        union_all(rates)
        .join(both, F.col("node") == both["src"])
        .select("block", "depth", "node", F.col("dst").alias("parent"), "rate")
        .join(parents, ["block", "depth", "parent"])
        .select(F.least("parent", "node").alias("src"), F.greatest("parent", "node").alias("dst"), credit.alias("credit"))
    )
    return flow.groupBy("src", "dst").agg(F.sum("credit").alias("credit")).where("credit > 0")


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``(id, component)``, named by the smallest id; vertices without edges stand alone.

    Alternating star contraction: each node's neighbours are tied to the smallest of
    them until every component is a star. A round needs minima and joins only, no
    neighbour lists, and the number of rounds grows with the logarithm of the size.
    """
    pairs = cut(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )
    while not is_star_forest(pairs):
        around = pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).union(
            pairs.select(F.col("v").alias("a"), F.col("u").alias("b"))
        )
        lowest = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = (
            around.join(lowest, "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("u"), F.col("low").alias("v"))
            .distinct()
        )
        below = large.groupBy("u").agg(F.min("v").alias("low"))
        pairs = cut(
            large.join(below, "u")
            .where(F.col("v") != F.col("low"))
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .union(below.select("u", F.col("low").alias("v")))
            .distinct()
        )
    named = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    everyone = vertices_of(edges) if vertices is None else vertices.select("id").distinct()
    return everyone.join(named, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def is_star_forest(pairs: DataFrame) -> bool:
    """True if every node hangs on one centre and no centre hangs on another node."""
    roles = pairs.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("centre")).union(
        pairs.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("centre"))
    )
    wrong = (
        roles.groupBy("node")
        .agg(F.sum("hangs").alias("hangs"), F.max("centre").alias("centre"))
        .where((F.col("hangs") > 1) | ((F.col("hangs") == 1) & (F.col("centre") == 1)))
    )
    return wrong.isEmpty()


def degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))


def modularity(
    components: DataFrame, a_edges: DataFrame, original_edges: DataFrame, ordered_pairs: bool = False
) -> DataFrame:
    """``(q)``: sum over same-community pairs of ``A - k_i k_j / 2m``, divided by 2m.

    Degrees and m come from the original graph, A from ``a_edges``. The degree
    products of all pairs of a community are ``((sum k)^2 - sum k^2) / 2``, so no pair
    is formed. ``ordered_pairs`` counts each pair twice.
    """
    m = original_edges.agg(F.count("*").cast("double"))
    side = components.select("id", "component")
    inside = (
        a_edges.join(side.select(F.col("id").alias("src"), F.col("component").alias("c1")), "src")
        .join(side.select(F.col("id").alias("dst"), F.col("component").alias("c2")), "dst")
        .where(F.col("c1") == F.col("c2"))
        .agg(F.count("*").cast("double"))
    )
    k = F.col("k").cast("double")
    products = (
        side.join(degrees(original_edges), "id")
        .groupBy("component")
        .agg(F.sum(k).alias("total"), F.sum(k * k).alias("squares"))
        .agg(F.sum((F.col("total") * F.col("total") - F.col("squares")) / 2).alias("products"))
    )
    factor = 2.0 if ordered_pairs else 1.0
    two_m = 2 * m.scalar()
    return products.select(
        (F.lit(factor) * (inside.scalar() - F.col("products") / two_m) / two_m).alias("q")
    )


def top_edges(scores: DataFrame, tol: float = 1e-6) -> DataFrame:
    """The edges whose betweenness is within ``tol`` of the maximum."""
    highest = scores.agg(F.max("betweenness"))
    return scores.where(F.abs(F.col("betweenness") - highest.scalar()) < tol)


def remove_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    return edges.join(removed.select("src", "dst"), ["src", "dst"], "left_anti")


def girvan_newman(edges: DataFrame, tol: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Best split found while cutting the edges of highest betweenness.

    Returns ``(labels(id, label), trace(step, max_bet, n_communities, q))``. The first
    partition with the highest modularity wins; the uncut graph is never a candidate
    and no vertex is ever dropped.

    Scores of an edge depend on its own component only, so a round cuts *every* component
    at its own maximum and notes the cuts as rows; there are as many rounds as a component
    is cut in a row, however many components there are. ``cut_steps`` merges the cuts into
    the steps that a loop over the whole graph would take (maxima within ``tol`` are one
    step). Modularity is a sum over communities, kept as whole numbers, so a cut is a
    difference and the best step has no rounding.
    """
    spark = edges.sparkSession
    original = cut(edges.select("src", "dst"))
    vertices = cut(vertices_of(original))
    two_m = 2 * original.count()
    k = cut(degrees(original).select("id", F.col("k").cast(WIDE).alias("k")))
    parts = cut(connected_components(original, vertices))
    start = parts.join(k, "id").groupBy("component").agg(F.sum("k").alias("total"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    products = start.agg(F.sum((F.col("total") * F.col("total") - F.col("squares")) / 2).cast(WIDE).alias("products"), F.count("*").alias("n")).first()
    cuts_path, moves_path = new_dir(spark, "split-cuts"), new_dir(spark, "split-moves")
    lineage = parts.select("component").distinct().withColumn("key", F.array().cast("array<bigint>"))
    current, live, turn = original, parts, 0
    while not current.isEmpty():
        place = live.select("id", F.col("component").alias("place"))
        scores = cut(edge_betweenness(current, order=place).join(place.withColumnRenamed("id", "src"), "src"))
        highest = scores.groupBy("place").agg(F.max("betweenness").alias("highest"))
        judged = scores.join(highest, "place").withColumn("falls", F.col("highest") - F.col("betweenness") < tol)
        kept = cut(judged.where("not falls").select("src", "dst"))
        ids = live.select("id")
        after = cut(connected_components(kept, ids).join(place, "id").join(k, "id"))
        children = after.groupBy("place", "component").agg(F.sum("k").alias("total"))
        split = children.groupBy("place").agg(
            F.count("*").alias("children"),
            F.sum("total").alias("whole"),
            F.sum(F.col("total") * F.col("total")).alias("squares"),
        )
        fallen = judged.where("falls").groupBy("place").agg(F.count("*").alias("fallen"), F.first("highest").alias("highest"))
        mark = F.round(-F.col("highest") / tol).cast("bigint")
        cuts = cut(
            fallen.join(split, "place")
            .join(lineage.withColumnRenamed("component", "place"), "place")
            .select(
                F.lit(turn).alias("turn"),
                "place",
                "highest",
                # what a later, lower maximum comes before no longer holds it back
                F.concat(F.filter("key", lambda x: x >= mark), F.array(mark)).alias("key"),
                (F.col("children") - 1).alias("more"),
                (-two_m * F.col("fallen") - (F.col("squares") - F.col("whole") * F.col("whole")) / 2).cast(WIDE).alias("gain"),
            )
        )
        cuts.write.mode("append").parquet(cuts_path)
        after.where("component <> place").select(F.lit(turn).alias("turn"), "place", "id", "component").write.mode("append").parquet(moves_path)
        ends = kept.select(F.col("src").alias("id")).join(after, "id").select("component").distinct()
        live = cut(after.join(ends, "component", "left_semi").select("id", "component"))
        lineage = cut(after.select("component", "place").distinct().join(ends, "component", "left_semi").join(cuts.select("place", "key"), "place").select("component", "key"))
        current, turn = kept, turn + 1
    empty = spark.createDataFrame([], "step int, max_bet double, n_communities bigint, q double")
    if turn == 0:
        return parts.select("id", F.col("component").alias("label")), empty
    cuts = cut(cut_steps(spark.read.parquet(cuts_path)))
    by_step = cuts.groupBy("step").agg(F.max("highest").alias("max_bet"), F.sum("more").alias("more"), F.sum("gain").cast(WIDE).alias("gain"))
    totals = cut(running_totals(by_step, "step", "more", "gain"))
    first_sum = F.lit(two_m * original.count() - int(products["products"])).cast(WIDE)
    steps = totals.select("step", "max_bet", (F.col("more") + products["n"]).alias("n_communities"), (F.col("gain") + first_sum).cast(WIDE).alias("sum"))
    best = steps.orderBy(F.desc("sum"), "step").first()["step"]
    moves = spark.read.parquet(moves_path).join(cuts.select("turn", "place", "step"), ["turn", "place"]).where(F.col("step") <= best)
    last = moves.groupBy("id").agg(F.max_by("component", "step").alias("moved"))
    labels = parts.join(last, "id", "left").select("id", F.coalesce("moved", "component").alias("label"))
    q = F.col("sum").cast("double") / (float(two_m) * float(two_m))
    return labels, steps.select(F.col("step").cast("int").alias("step"), "max_bet", "n_communities", q.alias("q"))


def cut_steps(cuts: DataFrame) -> DataFrame:
    """The cuts with the ``step`` they fall into when the highest maximum of all components goes first.

    A component can be cut once its predecessor is, and the highest comes next. So a cut waits
    for the lowest maximum on the way to it, then for the lowest after that one, and so on:
    ``key`` lists these, negated, and cuts go in its order. Equal keys are one step.
    """
    steps = dense_index(cuts, "key", "step").withColumn("step", F.col("step") + 1)
    return cuts.join(steps, "key")
