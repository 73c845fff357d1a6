"""Graph queries over the co-occurrence graph of customers and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..runtime import cut, new_dir
from ..sinks import writers
from . import views
from .registry import once, query
from .views import with_views

THRESHOLD = 4  # smallest number of shared items
#: Community splitting takes another graph: parts that were bought together in three orders. Its
#: components stay small at every scale, while a giant one of E edges takes up to E cuts in a row.
SPLIT_THRESHOLD = 3
DEPTH = 12  # of the searches in SQL, which give nothing if a path is longer
CHUNK = 4  # members of a row, small enough for communities of several rows


def edges(spark, sf_dir):
    return graph.cooccurrence_edges(views.pairs(spark, sf_dir), THRESHOLD)


def split_edges(spark, sf_dir):
    parts = views.table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    return graph.cooccurrence_edges(parts, SPLIT_THRESHOLD)


def sql_edges(recursive: bool = False) -> str:
    return with_views("pairs", recursive=recursive) + f""", edges AS MATERIALIZED (
        SELECT a.user_id AS src, b.user_id AS dst, count(*) AS shared FROM pairs a JOIN pairs b
        ON a.item = b.item AND a.user_id < b.user_id GROUP BY a.user_id, b.user_id
        HAVING count(*) >= {THRESHOLD})"""


SPLIT_EDGES_SQL = f"""WITH RECURSIVE baskets AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS part FROM lineitem),
    edges AS MATERIALIZED (
        SELECT a.part AS src, b.part AS dst, count(*) AS shared FROM baskets a JOIN baskets b
        ON a.basket = b.basket AND a.part < b.part GROUP BY a.part, b.part HAVING count(*) >= {SPLIT_THRESHOLD})"""


EDGES_SQL = sql_edges()

BOTH = """, both_ways AS MATERIALIZED (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
    verts AS (SELECT DISTINCT src AS id FROM both_ways)"""


def labels_sql(rounds: int = 5) -> str:
    steps = [", l0 AS (SELECT id, id AS label FROM verts)"]
    for i in range(rounds):
        steps.append(
            f""", l{i + 1} AS (SELECT id, label FROM (
            SELECT b.dst AS id, l.label, row_number() OVER (PARTITION BY b.dst ORDER BY count(*) DESC, l.label) AS rn
            FROM both_ways b JOIN l{i} l ON b.src = l.id GROUP BY b.dst, l.label) WHERE rn = 1)"""
        )
    return sql_edges() + BOTH + "".join(steps) + f", labels AS (SELECT id, label FROM l{rounds})"


LABELS_SQL = labels_sql()


def paths_sql(edges_sql: str) -> str:
    """Distances by a search that keeps one row for each root and node, then path counts level by level."""
    steps = [
        """, dist(root, node, level) USING KEY (root, node) AS (
        SELECT id, id, 0 FROM verts
        UNION SELECT d.root, b.dst, d.level + 1 FROM dist d JOIN both_ways b ON b.src = d.node
        ANTI JOIN recurring.dist k ON k.root = d.root AND k.node = b.dst),
    s0 AS MATERIALIZED (SELECT id AS root, id AS node, CAST(1 AS DOUBLE) AS sigma FROM verts)"""
    ]
    for i in range(1, DEPTH + 1):
        steps.append(
            f""", s{i} AS MATERIALIZED (
        SELECT p.root, b.dst AS node, sum(p.sigma) AS sigma FROM s{i - 1} p JOIN both_ways b ON b.src = p.node
        JOIN dist d ON d.root = p.root AND d.node = b.dst AND d.level = {i} GROUP BY p.root, b.dst)"""
        )
    whole = f"(SELECT count(*) FROM s{DEPTH}) = 0"
    levels = " UNION ALL ".join(f"SELECT root, node, {i} AS level, sigma FROM s{i} WHERE {whole}" for i in range(DEPTH))
    return edges_sql + BOTH + "".join(steps) + f", paths AS ({levels})"


def betweenness_sql(edges_sql: str) -> str:
    steps = [f", r{DEPTH} AS MATERIALIZED (SELECT root, node, CAST(0 AS DOUBLE) AS rate FROM s{DEPTH})"]
    for i in range(DEPTH - 1, -1, -1):
        steps.append(
            f""", r{i} AS MATERIALIZED (
        SELECT p.root, p.node, (1 + p.sigma * coalesce(sum(r.rate), 0)) / p.sigma AS rate
        FROM s{i} p LEFT JOIN (both_ways b JOIN r{i + 1} r ON r.node = b.dst) ON b.src = p.node AND r.root = p.root
        GROUP BY p.root, p.node, p.sigma)"""
        )
    flows = " UNION ALL ".join(
        f"""SELECT b.src, b.dst, p.sigma * r.rate AS credit FROM s{i} p JOIN both_ways b ON b.src = p.node
        JOIN r{i + 1} r ON r.root = p.root AND r.node = b.dst"""
        for i in range(DEPTH - 1)
    )
    return (
        paths_sql(edges_sql)
        + "".join(steps)
        + f""", betweenness AS (
        SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(credit) / 2 AS betweenness
        FROM ({flows}) WHERE (SELECT count(*) FROM s{DEPTH}) = 0 GROUP BY 1, 2)"""
    )


PATHS_SQL = paths_sql(sql_edges(recursive=True))
BETWEENNESS_SQL = betweenness_sql(sql_edges(recursive=True))
SPLIT_SQL = betweenness_sql(SPLIT_EDGES_SQL)


@query("grf1_cooccurrence_graph", EDGES_SQL + " SELECT src, dst, shared FROM edges")
def _(spark, sf_dir):
    return edges(spark, sf_dir)


@query("grf2_label_propagation", LABELS_SQL + " SELECT id, label FROM labels")
def _(spark, sf_dir):
    return graph.label_propagation(edges(spark, sf_dir))


@query(
    "grf3_communities",
    LABELS_SQL
    + f""" SELECT community, size, chunk, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members
    FROM (SELECT id, min(id) OVER (PARTITION BY label) AS community, count(*) OVER (PARTITION BY label) AS size,
          (row_number() OVER (PARTITION BY label ORDER BY id) - 1) // {CHUNK} AS chunk FROM labels)
    GROUP BY community, size, chunk""",
)
def _(spark, sf_dir):
    found = graph.communities(graph.label_propagation(edges(spark, sf_dir)), CHUNK)
    return found.withColumn("members", F.concat_ws(",", F.col("members").cast("array<string>")))


@query(
    "grf4_all_roots_bfs",
    PATHS_SQL + " SELECT root, node, level, CAST(sigma AS BIGINT) AS sigma FROM paths",
)
def _(spark, sf_dir):
    return graph.bfs_all(cut(edges(spark, sf_dir))).withColumn("sigma", F.col("sigma").cast("bigint"))


@query(
    "grf5_edge_betweenness",
    BETWEENNESS_SQL + " SELECT src, dst, round(betweenness, 4) AS betweenness FROM betweenness",
)
def _(spark, sf_dir):
    scores = graph.edge_betweenness(cut(edges(spark, sf_dir)))
    return scores.select("src", "dst", F.round("betweenness", 4).alias("betweenness"))


@query(
    "grf6_connected_components",
    sql_edges(recursive=True)
    + BOTH
    + """, reach(root, node) AS (
        SELECT id, id FROM verts UNION SELECT r.root, b.dst FROM reach r JOIN both_ways b ON b.src = r.node)
    SELECT root AS id, min(node) AS component FROM reach GROUP BY root""",
)
def _(spark, sf_dir):
    return graph.connected_components(cut(edges(spark, sf_dir)))


def modularity_sql(factor: str) -> str:
    return (
        LABELS_SQL
        + f""", deg AS (SELECT src AS id, count(*) AS k FROM both_ways GROUP BY src),
    m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM edges),
    pair AS (SELECT a.id AS i, b.id AS j, da.k AS ki, db.k AS kj FROM labels a JOIN labels b
             ON a.label = b.label AND a.id < b.id JOIN deg da ON da.id = a.id JOIN deg db ON db.id = b.id)
    SELECT round(sum({factor} * (CASE WHEN e.src IS NULL THEN 0 ELSE 1 END - ki * kj / (2 * m))) / (2 * max(m)), 6) AS q
    FROM pair LEFT JOIN edges e ON e.src = i AND e.dst = j, m"""
    )


def label_communities(spark, sf_dir):
    graph_edges = cut(edges(spark, sf_dir))
    labels = graph.label_propagation(graph_edges).withColumnRenamed("label", "component")
    return cut(labels), graph_edges


@query("grf7_modularity", modularity_sql("1"))
def _(spark, sf_dir):
    labels, graph_edges = label_communities(spark, sf_dir)
    a = labels.select(F.col("id").alias("src"), F.col("component").alias("c1"))
    b = labels.select(F.col("id").alias("dst"), F.col("component").alias("c2"))
    # the cut graph: edges between communities are gone
    current = graph_edges.join(a, "src").join(b, "dst").where("c1 = c2").select("src", "dst")
    return graph.modularity(labels, current, graph_edges).select(F.round("q", 6).alias("q"))


@query("grf8_modularity_ordered_pairs", modularity_sql("2"))
def _(spark, sf_dir):
    labels, graph_edges = label_communities(spark, sf_dir)
    return graph.modularity(labels, graph_edges, graph_edges, ordered_pairs=True).select(
        F.round("q", 6).alias("q")
    )


def split(spark, sf_dir):
    """Labels and trace of one run, which the queries of both share."""
    run = lambda: tuple(cut(df) for df in graph.girvan_newman(split_edges(spark, sf_dir)))
    return once(spark, "girvan-newman", sf_dir, run)


@query("grf9_girvan_newman")
def _(spark, sf_dir):
    return graph.community_members(split(spark, sf_dir)[0])


@query("grf9_girvan_newman_trace")
def _(spark, sf_dir):
    return split(spark, sf_dir)[1]


@query(
    "grf9_first_cut",
    SPLIT_SQL
    + """, kept AS (SELECT * FROM betweenness WHERE (SELECT max(betweenness) FROM betweenness) - betweenness >= 1e-6),
    two AS (SELECT src, dst FROM kept UNION ALL SELECT dst, src FROM kept),
    reach(root, node) AS (SELECT id, id FROM verts UNION SELECT r.root, b.dst FROM reach r JOIN two b ON b.src = r.node),
    comp AS MATERIALIZED (SELECT root AS id, min(node) AS component FROM reach GROUP BY root),
    deg AS (SELECT src AS id, count(*) AS k FROM both_ways GROUP BY src),
    m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM edges),
    sums AS (SELECT component, (sum(k) * sum(k) - sum(k * k)) / 2 AS products FROM comp JOIN deg USING (id) GROUP BY component)
    SELECT round((SELECT max(betweenness) FROM betweenness), 6) AS max_bet, CAST(count(*) AS BIGINT) AS n_communities,
           round(((SELECT count(*) FROM kept) - sum(products) / (2 * max(m))) / (2 * max(m)), 9) AS q FROM sums, m""",
)
def _(spark, sf_dir):
    first = split(spark, sf_dir)[1].where("step = 1")
    return first.select(F.round("max_bet", 6).alias("max_bet"), "n_communities", F.round("q", 9).alias("q"))


@query(
    "agg13_edge_credit_sum",
    BETWEENNESS_SQL
    + """ SELECT CAST(count(*) AS BIGINT) AS edges, round(sum(betweenness), 3) AS total,
    round(max(betweenness), 4) AS highest FROM betweenness""",
)
def _(spark, sf_dir):
    return graph.edge_betweenness(cut(edges(spark, sf_dir))).agg(
        F.count("*").alias("edges"),
        F.round(F.sum("betweenness"), 3).alias("total"),
        F.round(F.max("betweenness"), 4).alias("highest"),
    )


@query(
    "snk4_community_report",
    LABELS_SQL
    + """, c AS (SELECT min(id) OVER (PARTITION BY label) AS community,
                 count(*) OVER (PARTITION BY label) AS size, id FROM labels),
    o AS (SELECT id, row_number() OVER (ORDER BY size, community, id) AS pos, id = community AS opens FROM c)
    SELECT CAST(id AS VARCHAR) AS value FROM o
    UNION ALL SELECT CASE WHEN NOT opens THEN ',' WHEN pos = 1 THEN '' ELSE chr(10) END FROM o""",
)
def _(spark, sf_dir):
    path = new_dir(spark, "communities")
    members = graph.community_members(graph.label_propagation(edges(spark, sf_dir)))
    writers.write_community_report(cut(members), path)
    return spark.read.option("lineSep", "'").text(path)


REPORT_SQL = """ SELECT '(''' || src || ''', ''' || dst || '''),' || CAST(round(betweenness, 5) AS VARCHAR) AS value
    FROM betweenness"""


def edge_report(spark, scores):
    path = new_dir(spark, "edge-report")
    writers.write_edge_report(cut(scores), path)
    return spark.read.text(path)


@query("snk5_edge_report", SPLIT_SQL + REPORT_SQL)
def _(spark, sf_dir):
    return edge_report(spark, graph.edge_betweenness(cut(split_edges(spark, sf_dir))))


@query("snk5_betweenness_report", BETWEENNESS_SQL + REPORT_SQL)
def _(spark, sf_dir):
    return edge_report(spark, graph.edge_betweenness(cut(edges(spark, sf_dir))))
