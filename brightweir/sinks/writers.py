"""Writers for the reports. Line reports are written as sorted pieces of text.

A report line may list a whole community or all itemsets of one size, which no
single row should have to hold. So each member is one row, the rows are globally
sorted, and each row opens with whatever separates it from the one before. The text
writer closes every row with the character all members end in instead of a line
end: the part files read in order are the report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import edge_score_line, itemset_label


def write_json_report(report: DataFrame, path: str) -> None:
    """A one-row report as a single JSON object."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Materialise a cleaned table once; later stages read the copy."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_pieces(pieces: DataFrame, path: str, closing: str) -> None:
    """Write the sorted ``text`` rows, each followed by ``closing``."""
    pieces.select(F.col("text").alias("value")).write.mode("overwrite").option("lineSep", closing).text(path)


def itemset_pieces(itemsets: DataFrame, opening: str) -> DataFrame:
    """``(size, itemset, text)``: one section of the itemset report.

    ``opening`` goes before the very first set; later sizes start after a blank
    line. The closing bracket is left to the writer.
    """
    first = itemsets.groupBy("size").agg(F.min("itemset").alias("first_set"))
    smallest = itemsets.agg(F.min("size")).scalar()
    lead = (
        F.when(F.col("itemset") != F.col("first_set"), ",")
        .when(F.col("size") == smallest, opening)
        .otherwise("\n\n")
    )
    label = itemset_label(F.col("itemset"))
    text = F.concat(lead, F.left(label, F.length(label) - 1))
    return itemsets.join(first, "size").select("size", "itemset", text.alias("text"))


def write_itemset_report(candidates: DataFrame, frequent: DataFrame, path: str) -> None:
    """Candidates section, then frequent section, grouped by size."""
    sections = (
        itemset_pieces(candidates, "Candidates:\n")
        .withColumn("section", F.lit(1))
        .unionByName(itemset_pieces(frequent, "\n\nFrequent Itemsets:\n").withColumn("section", F.lit(2)))
    )
    write_pieces(sections.orderBy("section", "size", "itemset"), path, closing=")")


def community_pieces(members: DataFrame) -> DataFrame:
    """``members(community, id, size)`` to one quoted piece per member.

    The community is named by its smallest member, so ordering by size, name and
    id gives the report order. The closing quote is left to the writer.
    """
    start = members.agg(F.min(F.struct("size", "community"))).scalar()
    lead = (
        F.when(F.col("id") != F.col("community"), ",")
        .when(F.struct("size", "community") == start, "")
        .otherwise("\n")
    )
    text = F.concat(lead, F.lit("'"), F.col("id").cast("string"))
    return members.select("size", "community", "id", text.alias("text"))


def write_community_report(members: DataFrame, path: str) -> None:
    write_pieces(community_pieces(members).orderBy("size", "community", "id"), path, closing="'")


def edge_report(scores: DataFrame, score: str = "betweenness") -> DataFrame:
    """``('u', 'v'),x`` lines by unrounded score descending, then edge."""
    return scores.orderBy(F.col(score).desc(), "src", "dst").select(
        edge_score_line(F.col("src"), F.col("dst"), F.col(score)).alias("value")
    )


def write_edge_report(scores: DataFrame, path: str, score: str = "betweenness") -> None:
    edge_report(scores, score).write.mode("overwrite").text(path)
