"""The constants of the queries leave work on the largest tables."""

import pytest

import __spark_entry__ as contract

LARGE = "/root/testdata/sf0.1"


GRAPHS = [
    "grf1_cooccurrence_graph",
    "grf2_label_propagation",
    "grf4_all_roots_bfs",
    "grf5_edge_betweenness",
    "grf6_connected_components",
    "grf9_girvan_newman_trace",
    "snk5_edge_report",
]


@pytest.mark.parametrize("name", GRAPHS)
def test_graph_of_the_largest_tables_has_edges(spark, name):
    assert not contract.queries()[name](spark, LARGE).isEmpty()


def test_itemsets_of_the_largest_tables_reach_pairs(spark):
    assert contract.queries()["fim2_apriori_many_items"](spark, LARGE).agg({"size": "max"}).first()[0] >= 2
