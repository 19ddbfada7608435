"""Duplicate detection: exact, normalised and fuzzy edges, connected components, election, marking.

Edges run between distinct strings, never between rows. Fuzzy pairs are sought among all pairs of a first letter, in tiles of
bounded size, so no task holds a whole block and only pairs that reach the threshold leave a tile; components are found by label propagation over DataFrames with the lineage cut in the shared folder.
Tables of strings and edges are joined by sorting: their size in memory is many times what the planner reckons from the compressed file, so
what it would broadcast may not fit the driver. Only the blocks, one row a first letter, are broadcast.

Null keywords are no duplicates. Ties are broken by length, then by the string. Empty inputs give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.operators.nearpairs import near_pairs
from lexiforge.runtime import cut_unsized as cut
from lexiforge.runtime import forget, join_unique

THRESHOLD, MIN_CONFIDENCE, MAX_GROUP = 90.0, 80.0, 50
TILE, MAX_TASKS = 30_000, 2_000


def exact_edges(df: DataFrame, column: str = "keyword") -> DataFrame:
    """(src, dst, strategy, confidence, n): a self-edge for each value that occurs more than once; n is its surplus rows."""
    many = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return many.select(F.col(column).alias("src"), F.col(column).alias("dst"), F.lit("exact").alias("strategy"), F.lit(100.0).alias("confidence"), (F.col("rows") - 1).alias("n"))


def light_key(column: str = "keyword"):
    return F.trim(F.regexp_replace(F.lower(column), r"[\s\x0B\xA0]+", " "))


def normalised_edges(df: DataFrame, column: str = "keyword", order: str = "row_id") -> DataFrame:
    """Edges from the first string of each key to the other strings of it; n counts their rows."""
    strings = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    keyed = strings.withColumn("_key", light_key(column))
    canon = keyed.groupBy("_key").agg(F.min_by(column, "_first").alias("src"), F.count(F.lit(1)).alias("_strings")).filter("_strings > 1")
    return (
        keyed.join(canon.hint("merge"), "_key")
        .filter(F.col(column) != F.col("src"))
        .select("src", F.col(column).alias("dst"), F.lit("normalized").alias("strategy"), F.lit(95.0).alias("confidence"), "n")
    )


def prefix_block(column: str = "keyword", n: int = 1):
    return F.lower(F.substring(column, 1, n))


def _compare(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile = pd.concat(list(frames))
        left, right = tile["s"][tile["part"] == tile["i"]], tile["s"][tile["part"] != tile["i"]]
        own = tile["i"].iat[0] == tile["j"].iat[0]
        for a, b, confidence in near_pairs(left.tolist(), None if own else right.tolist(), threshold):
            yield pd.DataFrame({"a": a, "b": b, "confidence": confidence})

    return run


def fuzzy_edges(strings: DataFrame, threshold: float = THRESHOLD, column: str = "keyword") -> DataFrame:
    """Edges between distinct strings of a block whose Indel ratio reaches the threshold; src < dst.

    A block of n strings is dealt to m = n / TILE parts by hash; each pair of parts is a tile, in which all pairs are compared.
    """
    s = cut(strings.select(F.col(column).alias("s")).filter(F.length("s") > 0).distinct().withColumn("block", prefix_block("s")))
    blocks = cut(s.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("m")))
    n_tiles = blocks.agg(F.sum(F.expr("m * (m + 1L) / 2")).cast("long")).first()[0] or 1
    tiles = (
        s.join(F.broadcast(blocks), "block")
        .withColumn("part", F.pmod(F.xxhash64("s"), F.col("m")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select("block", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "s")
        .repartition(min(n_tiles, MAX_TASKS), "block", "i", "j")
    )
    return tiles.groupBy("block", "i", "j").applyInPandas(_compare(threshold), "a string, b string, confidence double").select(
        F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.lit("fuzzy").alias("strategy"), "confidence"
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, for the nodes of edges between different strings.

    Each round takes the least label over the neighbours and then follows the label's own label, which halves the
    distance left; hubs are reduced on the map side. The rounds run over numbers in the order of the strings, so that each
    writes little, and what a round no longer needs is dropped before the next.
    """
    spark = edges.sparkSession
    pairs = edges.filter("src <> dst").select("src", "dst")
    names = pairs.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    names = cut(names.orderBy("name").select("name", F.monotonically_increasing_id().alias("id")))
    number = lambda c: names.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id")).hint("merge")
    ends = pairs.join(number("src"), "src").join(number("dst"), "dst")
    both = cut(ends.select(F.explode(F.expr("array(struct(src_id AS src, dst_id AS dst), struct(dst_id AS src, src_id AS dst))")).alias("e")).select("e.*").distinct())
    labels = cut(both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("label")).select(F.col("src").alias("node"), "label"))
    changed = True
    while changed:  # labels only fall, so it ends; the distance left halves each round
        near = both.join(labels.hint("merge"), both.dst == labels.node).groupBy("src").agg(F.min("label").alias("near"))
        hop = labels.select(F.col("node").alias("_n"), F.col("label").alias("hop"))
        stepped = (
            labels.join(near.hint("merge"), labels.node == near.src, "left")
            .join(hop.hint("merge"), labels.label == hop["_n"], "left")
            .select("node", F.least("label", F.coalesce("near", "label"), F.coalesce("hop", "label")).alias("label"), F.col("label").alias("_old"))
        )
        stepped = cut(stepped)
        changed = not stepped.filter("label <> _old").isEmpty()
        labels = stepped.drop("_old")
        del near, hop, stepped
        forget(spark)
    told = labels.join(names.select(F.col("id").alias("node"), "name").hint("merge"), "node").select(F.col("name").alias("node"), "label")
    return told.join(names.select(F.col("id").alias("label"), "name").hint("merge"), "label").select("node", F.col("name").alias("label"))


def groups(edges: DataFrame, min_confidence: float = MIN_CONFIDENCE, max_size: int | None = None) -> DataFrame:
    """(group_id, canonical, member, confidence): the shortest string of each component stands for it.

    Confidence is the mean over the edges of the group, self-edges of exact duplicates included. With ``max_size`` groups keep
    only that many members (an option of the feature; the default keeps all).
    """
    strong = edges.filter(F.col("confidence") >= min_confidence)
    label = cut(components(strong))
    weight = (
        strong.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
        .join(label.select(F.col("node").alias("src"), "label").hint("merge"), "src")
        .groupBy("label").agg(F.round(F.avg("confidence"), 6).alias("confidence"))
    )
    elected = label.groupBy("label").agg(F.min(F.struct(F.length("node").alias("n"), F.col("node"))).alias("best")).select("label", F.col("best.node").alias("canonical"))
    out = label.join(elected.hint("merge"), "label").join(weight.hint("merge"), "label").select(F.col("label").alias("group_id"), "canonical", F.col("node").alias("member"), "confidence")
    if max_size is None:
        return out
    from pyspark.sql import Window

    w = Window.partitionBy("group_id").orderBy(F.length("member"), "member")
    return out.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= max_size).drop("_k")


def mark_status(df: DataFrame, grouped: DataFrame, column: str = "keyword", order: str = "row_id") -> DataFrame:
    """Adds status ACTIVE or DUPLICATE and the group's id; all rows stay. Non-first rows and non-canonical members are duplicates."""
    first = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_first"))
    member = grouped.select(F.col("member").alias(column), "group_id", (F.col("member") != F.col("canonical")).alias("_other"))
    strings = first.join(member.hint("merge"), column, "left")  # one row a string
    out = join_unique(df, strings, column, hint="merge")
    dup = (F.col(order) != F.col("_first")) | F.coalesce("_other", F.lit(False))
    return out.withColumn("status", F.when(dup, "DUPLICATE").otherwise("ACTIVE")).drop("_first", "_other")


def dedup_statistics(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """(metric, n): candidates by strategy and rows by status."""
    a = edges.groupBy(F.concat(F.lit("candidates_"), F.col("strategy")).alias("metric")).agg(F.sum("n").cast("long").alias("n"))
    b = marked.groupBy(F.concat(F.lit("rows_"), F.lower("status")).alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


def all_edges(df: DataFrame, column: str = "keyword", order: str = "row_id", threshold: float = THRESHOLD) -> DataFrame:
    """Edges of all strategies in order of priority: strings resolved by an earlier one are left out of the later ones."""
    exact = exact_edges(df, column)
    norm = cut(normalised_edges(df, column, order))
    left = df.select(column).filter(F.col(column).isNotNull()).distinct().join(norm.select(F.col("dst").alias(column)).hint("merge"), column, "left_anti")
    fuzzy = fuzzy_edges(left, threshold, column).withColumn("n", F.lit(1).cast("long"))
    edges = cut(exact.unionByName(norm).unionByName(fuzzy))
    del exact, norm, left, fuzzy
    forget(df.sparkSession)
    return edges


def detect(df: DataFrame, column: str = "keyword", order: str = "row_id", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """All edges, and all rows marked by their groups: (edges, marked)."""
    edges = all_edges(df, column, order, threshold)
    return edges, mark_status(df, groups(edges), column, order)
