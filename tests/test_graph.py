import random
from collections import deque
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from brightweir.operators import graph


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "src bigint, dst bigint")


def cliques(a=4, b=3):
    left, right = range(a), range(100, 100 + b)
    edges = set(combinations(left, 2)) | set(combinations(right, 2)) | {(0, 100)}
    return edges, set(left), set(right)


def random_edges(seed, n=14, p=0.18):
    rng = random.Random(seed)
    return {e for e in combinations(range(n), 2) if rng.random() < p}


def neighbours(edges):
    out = {}
    for u, v in edges:
        out.setdefault(u, set()).add(v)
        out.setdefault(v, set()).add(u)
    return out


def paths_from(root, near):
    dist, sigma, queue = {root: 0}, {root: 1}, deque([root])
    while queue:
        u = queue.popleft()
        for v in near[u]:
            if v not in dist:
                dist[v], sigma[v] = dist[u] + 1, 0
                queue.append(v)
            if dist[v] == dist[u] + 1:
                sigma[v] += sigma[u]
    return dist, sigma


def brute_betweenness(edges):
    """Closed form: share of the shortest s-t paths that run over the edge."""
    near = neighbours(edges)
    info = {v: paths_from(v, near) for v in near}
    score = {}
    for u, v in edges:
        total = 0.0
        for s, t in combinations(near, 2):
            ds, ss = info[s]
            dt, st = info[t]
            if t not in ds:
                continue
            for x, y in ((u, v), (v, u)):
                if x in ds and y in dt and ds[x] + 1 + dt[y] == ds[t]:
                    total += ss[x] * st[y] / ss[t]
        score[(u, v)] = total
    return score


def brute_components(edges, vertices):
    name = {v: v for v in vertices}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            low = min(name[u], name[v])
            if name[u] != low or name[v] != low:
                name[u] = name[v] = low
                changed = True
    return name


def brute_split(edges):
    """Plain loop over the whole graph: what the split must give."""
    near = neighbours(edges)
    degree = {v: len(near[v]) for v in near}
    m = len(edges)
    current, best, best_q, trace = set(edges), None, float("-inf"), []
    while current:
        score = brute_betweenness(current)
        top = max(score.values())
        current = {e for e in current if abs(score[e] - top) >= 1e-6}
        name = brute_components(current, near)
        q = sum(
            ((i, j) in current) - degree[i] * degree[j] / (2 * m)
            for i, j in combinations(sorted(near), 2)
            if name[i] == name[j]
        ) / (2 * m)
        trace.append((top, len(set(name.values())), q))
        if q > best_q + 1e-12:
            best_q, best = q, name
    return best, trace


def test_bridge_betweenness_and_first_cut(spark):
    edges, left, right = cliques()
    scores = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(frame(spark, edges)).collect()}
    assert scores[(0, 100)] == pytest.approx(len(left) * len(right))
    top = graph.top_edges(graph.edge_betweenness(frame(spark, edges))).collect()
    assert [(r.src, r.dst) for r in top] == [(0, 100)]


def test_betweenness_equals_closed_form(spark):
    edges = random_edges(3)
    got = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(frame(spark, edges)).collect()}
    expected = brute_betweenness(edges)
    assert got.keys() == expected.keys()
    assert all(got[e] == pytest.approx(expected[e]) for e in expected)


def test_components_of_chain_star_and_loner(spark):
    chain = {(i, i + 1) for i in range(20, 40)}
    star = {(1, i) for i in range(2, 12)}
    vertices = spark.range(0, 41).withColumnRenamed("id", "id")
    got = graph.connected_components(frame(spark, chain | star), vertices).collect()
    expected = brute_components(chain | star, range(41))
    assert {r.id: r.component for r in got} == expected


def test_split_recovers_planted_cliques(spark):
    edges, left, right = cliques()
    labels, trace = graph.girvan_newman(frame(spark, edges))
    groups = {}
    for r in labels.collect():
        groups.setdefault(r.label, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [sorted(left), sorted(right)]
    assert trace.orderBy("step").first().max_bet == pytest.approx(len(left) * len(right))


def test_split_trace_equals_plain_loop(spark):
    edges = random_edges(11, n=9, p=0.25)
    labels, trace = graph.girvan_newman(frame(spark, edges))
    best, expected = brute_split(edges)
    steps = trace.orderBy("step").collect()
    assert len(steps) == len(expected)
    for row, (top, n, q) in zip(steps, expected):
        assert row.max_bet == pytest.approx(top)
        assert row.n_communities == n
        assert row.q == pytest.approx(q)
    assert {r.id: r.label for r in labels.collect()} == best


def test_modularity_against_pairs(spark):
    edges = random_edges(7)
    near = neighbours(edges)
    label = {v: v % 3 for v in near}
    components = spark.createDataFrame(list(label.items()), "id bigint, component int")
    m = len(edges)
    expected = sum(
        ((i, j) in edges) - len(near[i]) * len(near[j]) / (2 * m)
        for i, j in combinations(sorted(near), 2)
        if label[i] == label[j]
    ) / (2 * m)
    df = frame(spark, edges)
    assert graph.modularity(components, df, df).first().q == pytest.approx(expected)
    assert graph.modularity(components, df, df, ordered_pairs=True).first().q == pytest.approx(2 * expected)


def test_label_propagation_and_communities(spark):
    edges, left, right = cliques(5, 4)
    labels = graph.label_propagation(frame(spark, edges))
    found = graph.communities(labels).collect()
    assert sorted(r.members for r in found) == [sorted(left), sorted(right)]
    # a large community is spread over several rows
    chunks = graph.communities(labels, chunk_size=2).where(F.col("community") == 0).collect()
    assert len(chunks) > 1
    assert sorted(i for r in chunks for i in r.members) == sorted(left)


def test_splits_of_many_components_merge_into_the_loop(spark):
    """Three components whose cuts interleave, two of them alike: equal maxima are one step."""
    part = random_edges(5, n=7, p=0.4)
    edges = set()
    for offset in (0, 100):
        edges |= {(u + offset, v + offset) for u, v in part}
    edges |= {(200 + i, 201 + i) for i in range(5)}
    labels, trace = graph.girvan_newman(frame(spark, edges))
    best, expected = brute_split(edges)
    steps = trace.orderBy("step").collect()
    assert [(r.n_communities, round(r.max_bet, 6), round(r.q, 9)) for r in steps] == [(n, round(t, 6), round(q, 9)) for t, n, q in expected]
    assert {r.id: r.label for r in labels.collect()} == best


def test_split_without_edges(spark):
    labels, trace = graph.girvan_newman(frame(spark, [(1, 2)]).where("false"))
    assert labels.count() == 0 and trace.count() == 0


def test_searches_from_some_roots_in_turns(spark):
    edges = random_edges(3, n=40, p=0.08)
    near = neighbours(edges)
    roots = spark.createDataFrame([(v,) for v in sorted(near)[::2]], "id bigint")
    got = {(r.root, r.node): (r.level, r.sigma) for r in graph.bfs_all(frame(spark, edges), roots).collect()}
    expected = {}
    for v in sorted(near)[::2]:
        dist, sigma = paths_from(v, near)
        expected.update({(v, n): (dist[n], sigma[n]) for n in dist})
    assert got == expected
    whole = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(frame(spark, edges)).collect()}
    turns = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(frame(spark, edges), at_once=1).collect()}
    assert all(turns[e] == pytest.approx(whole[e]) for e in edges)
