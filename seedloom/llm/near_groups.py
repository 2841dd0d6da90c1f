"""Groups of near-duplicate records (problem 2): pigeonhole blocks, Hamming distance, exact check, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Workspace, table
from .fingerprint import FINGERPRINT, blocks, components, direct_pairs, leader_pairs, signatures, slice_of, slices, verified


def near_duplicate_groups(df: DataFrame, id_col: str = "row_id", text_col: str = "text", threshold: float = 0.70) -> DataFrame:
    """(group_id, id) of every record in a group of two or more.

    Records of 3-gram similarity ``threshold`` or more are connected; a group is everything connected, directly or
    through others, and ``group_id`` its smallest id. Records with one gram set form a class first, so copies cost
    nothing later. Classes are compared if they share a fingerprint block and their Hamming distance is small, and
    each link is confirmed on the texts.

    Links that say nothing new aren't looked for: first every class is compared with its nearest candidates, then only
    candidates in different components, and the components of those links are those of the components found before.

    A block of more than ``DIRECT_BLOCK`` classes is not joined with itself. Its classes are compared with the block's
    first class and their predecessor; after the components of all links so far are known, only pairs of that block
    that lie in different components remain, and those are compared without exception. So no pair that shares a block
    is left out, and a large group of near-copies costs in proportion to its size.

    Null texts and texts under three characters are in no group; rows with a null id are ignored; repeated ids count
    as one record; further columns are ignored; an empty table gives an empty result.
    """
    work = Workspace(df.sparkSession, "near-groups")
    signed = work.keep(signatures(df, id_col, text_col), "signatures")
    classes = work.keep(signed.groupBy("same", "n").agg(F.min("id").alias("id"), *(F.first(w).alias(w) for w in FINGERPRINT.columns), F.first("keys").alias("keys")).drop("same"), "classes")
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    blocked = blocks(work, classes)
    near = direct_pairs(blocked, threshold, lambda a, b: F.col(f"{a}.id") < F.col(f"{b}.id"))
    if blocked.any_large:
        near = near.union(leader_pairs(blocked, threshold, ["id"])).distinct()
    pairs = work.keep(near, "pairs")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
    nearest = both.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("at")).select(F.least("at.a", "b").alias("a"), F.greatest("at.a", "b").alias("b"))
    links = work.keep(verified(nearest.distinct(), texts, threshold), "links")
    found = components(work, links)
    left = pairs.select("a", "b").join(nearest, ["a", "b"], "left_anti")
    if blocked.any_large:
        left = left.union(_across(blocked.large, found, threshold)).distinct()
    left = work.keep(_apart(left, found), "pairs")
    late = work.keep(verified(left.select("a", "b"), texts, threshold).join(left, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "links")
    # what was one component stays one: only the smallest ids of components are joined further
    over = components(work, late)
    found = work.keep(_merged(found, over), "components")
    work.drop(links, left, late, pairs)
    grouped = signed.select("id", "same", "n").join(classes.select(F.col("id").alias("class")).join(found.withColumnRenamed("id", "class"), "class", "left").join(signed.select(F.col("id").alias("class"), "same", "n"), "class"), ["same", "n"])
    rows = grouped.select(F.coalesce("root", "class").alias("group_id"), "id").distinct()
    sizes = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("group_id")
    return rows.join(sizes, "group_id").select("group_id", F.col("id").alias(id_col))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, root_a, root_b) of the pairs whose classes lie in different components."""
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}")), side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    return pairs.filter("root_a <> root_b").select("a", "b", "root_a", "root_b")


def _merged(found: DataFrame, over: DataFrame) -> DataFrame:
    """(id, root) of all classes in a component, whose roots may have been joined by ``over``."""
    final = over.select(F.col("id").alias("root"), F.col("root").alias("final"))
    nodes = found.join(final, "root", "left").select("id", F.coalesce("final", "root").alias("root"))
    return nodes.union(over.join(found.select("id"), "id", "left_anti").select("id", "root"))


def _across(large: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of large blocks whose classes lie in different components.

    Of each block only the classes outside its largest component meet the others, so a block that is one component
    costs nothing. The others are cut into slices, as a block may hold a third of all classes, and the few go to each.
    """
    members = large.join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    counts = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = counts.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("c", "root")).alias("top")).filter("roots > 1")
    marked = members.join(mixed.select("key", F.col("top.root").alias("major")), "key")
    few = marked.filter(F.col("root") != F.col("major")).withColumn("slice", F.explode(F.sequence(F.lit(0), slices() - 1)))
    all_ = marked.withColumn("slice", slice_of())
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.slice") == F.col("b.slice"))
    once = (F.col("b.root") == F.col("b.major")) | (F.col("a.id") < F.col("b.id"))
    joined = few.alias("a").join(all_.alias("b"), same & (F.col("a.root") != F.col("b.root")) & once & FINGERPRINT.near("a", "b", threshold))
    return joined.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def p2_found(spark, sf_dir):
    return near_duplicate_groups(table(spark, sf_dir, "synthetic_data", "row_id", "text"))
