"""Directory tree as a node table and its text rendering.

Nodes come from exploding each file's path prefixes and grouping by node
(partial aggregation); sibling order is the rank of the first file under the
node; ``is_last`` compares with the largest sibling rank (an aggregate + join,
no window over a huge directory); the prefix of a line is built from the
ancestors' ``is_last`` flags via an equi-join on ancestor paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.config import FILE_EMOJI, FOLDER_EMOJI, TREE_BRANCH, TREE_CORNER, TREE_HORIZONTAL, TREE_VERTICAL
from quire.functions.text import explode_rows


def tree_nodes(files: DataFrame) -> DataFrame:
    """(project, node, parent, name, depth, is_dir, first_rank, is_last) from
    ``files(project, rel_path, rank)``; ``node``/``parent`` are '/'-joined paths."""
    parts = F.split("rel_path", "/", -1)
    f = files.select("project", "rank", parts.alias("parts"))
    pre = explode_rows(f, F.sequence(F.lit(1), F.size("parts")), ["project", "rank", "parts"], "_i", "k")
    pre = pre.select("project", "rank",
                     F.array_join(F.slice("parts", 1, F.col("k")), "/").alias("node"),
                     F.when(F.col("k") > 1, F.array_join(F.slice("parts", 1, F.col("k") - 1), "/")).otherwise(F.lit(""))
                     .alias("parent"),
                     F.element_at("parts", F.col("k")).alias("name"), (F.col("k") - 1).alias("depth"),
                     (F.col("k") < F.size("parts")).alias("is_dir"))
    nodes = pre.groupBy("project", "node", "parent", "name", "depth").agg(
        F.min("rank").alias("first_rank"), F.min_by("is_dir", "rank").alias("is_dir"))
    last = nodes.groupBy("project", "parent").agg(F.max("first_rank").alias("last_rank"))
    return (nodes.join(last, ["project", "parent"])
            .withColumn("is_last", F.col("first_rank") == F.col("last_rank")).drop("last_rank"))


def dir_tree(files: DataFrame, max_depth: int = 100, show_emoji: bool = True) -> DataFrame:
    """(project, ord_key, depth, line): one rendered line per node within
    ``max_depth``; ``ord_key`` (array of ancestor first ranks) sorts lines in
    render order."""
    nodes = tree_nodes(files).where(F.col("depth") < max_depth)
    parts = F.split("node", "/", -1)
    anc = explode_rows(nodes.select("project", "node", parts.alias("parts"), "depth"),
                       F.sequence(F.lit(1), F.size("parts")), ["project", "node"], "_i", "k")
    anc = anc.select("project", "node", F.array_join(F.slice(F.split("node", "/", -1), 1, F.col("k")), "/").alias("anc"))
    info = nodes.select("project", F.col("node").alias("anc"), F.col("depth").alias("ad"),
                        F.col("is_last").alias("al"), F.col("first_rank").alias("ar"))
    chain = (anc.join(info, ["project", "anc"])
             .groupBy("project", "node")
             .agg(F.array_sort(F.collect_list(F.struct("ad", "al", "ar"))).alias("chain")))
    pieces = F.transform(F.filter("chain", lambda s: s["ad"] < F.col("depth")),
                         lambda s: F.when(s["al"], F.lit("  ")).otherwise(F.lit(TREE_VERTICAL + " ")))
    prefix = F.array_join(pieces, "")
    conn = F.when(F.col("depth") > 0, F.when(F.col("is_last"), F.lit(TREE_CORNER + TREE_HORIZONTAL))
                  .otherwise(F.lit(TREE_BRANCH + TREE_HORIZONTAL))).otherwise(F.lit(""))
    emoji = (F.when(F.col("is_dir"), F.lit(FOLDER_EMOJI + " ")).otherwise(F.lit(FILE_EMOJI + " "))
             if show_emoji else F.lit(""))
    out = nodes.join(chain, ["project", "node"])
    return out.select("project", "node", F.transform("chain", lambda s: s["ar"]).alias("ord_key"), "depth",
                      F.concat(prefix, conn, emoji, F.col("name")).alias("line"))
