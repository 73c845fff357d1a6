"""brightweir: review reports, itemsets, graphs, similarity, recommendation and
stream sketches as plain Spark DataFrame jobs."""
