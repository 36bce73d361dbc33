"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

1. Every partition permutes its rows locally (sort by a random number inside the partition)
   and numbers them; the numbered rows are written to the shared folder, so that a lost
   executor cannot renumber them.
2. The numbers of rows that go from each partition to each shard are drawn exactly: a binary
   tree over the partitions splits the shards' remaining capacities level by level, each
   split being a multivariate hypergeometric draw (univariate draws by inversion from the
   mode outwards).  Only counts, one per partition, take part.
3. A row's shard follows from its local number and its partition's counts.
4. In each shard the rows are permuted again: a random key deals them to buckets, and the
   rank inside the bucket plus the bucket's offset is the slot.

All of it is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import read_table, store

#: Rows of a bucket of the second permutation, and the fewest buckets of a shard.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 18, 32


def _log_factorial(n: Column) -> Column:
    """Stirling's series at n + 8, taken back by the eight factors."""
    x = n.cast("double") + F.lit(9.0)
    series = ((x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi)
              + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))))
    d, back = n.cast("double"), None
    for i in range(1, 9):
        back = (d + i) if back is None else back * (d + i)
    return series - F.log(back)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def hypergeometric(good: Column, bad: Column, drawn: Column, u: Column) -> Column:
    """The number of good ones among ``drawn`` of ``good + bad``, by inversion of the uniform
    number ``u``, from the mode outwards; 12 standard deviations hold all but 1e-30."""
    low = F.greatest(F.lit(0).cast("long"), drawn - bad)
    high = F.least(good, drawn)
    mode = F.greatest(low, F.least(high, F.floor((drawn + 1).cast("double") * (good + 1) / (good + bad + 2)).cast("long")))
    total = F.greatest((good + bad).cast("double"), F.lit(1.0))
    sd = F.sqrt(drawn * (good / total) * (bad / total) * ((total - drawn) / F.greatest(total - 1, F.lit(1.0))))
    width = F.least(F.greatest(high - mode, mode - low), (12 * F.coalesce(sd, F.lit(0.0))).cast("long") + 20)
    at_mode = F.exp(_log_choose(good, mode) + _log_choose(bad, drawn - mode) - _log_choose(good + bad, drawn))
    args = F.struct(good.alias("g"), bad.alias("b"), drawn.alias("k"), low.alias("lo"), high.alias("hi"),
                    mode.alias("m"), at_mode.alias("p"), u.alias("u"), width.alias("w"))

    def draw(a: Column) -> Column:
        start = F.struct((a["u"] - a["p"]).alias("left"), a["p"].alias("up"), a["p"].alias("down"),
                         F.when(a["u"] < a["p"], a["m"]).alias("got"))

        def step(s: Column, i: Column) -> Column:
            x, y = (a["m"] + i).cast("double"), (a["m"] - i).cast("double")
            up = F.when(x <= a["hi"], s["up"] * (a["g"] - x + 1) * (a["k"] - x + 1) / (x * (a["b"] - a["k"] + x))).otherwise(F.lit(0.0))
            down = F.when(y >= a["lo"], s["down"] * (y + 1) * (a["b"] - a["k"] + y + 1) / ((a["g"] - y) * (a["k"] - y))).otherwise(F.lit(0.0))
            left = s["left"]
            return F.when(s["got"].isNotNull(), s).otherwise(F.struct(
                (left - up - down).alias("left"), up.alias("up"), down.alias("down"),
                F.when(left < up, a["m"] + i).when(left < up + down, a["m"] - i).alias("got")))

        end = F.when(a["w"] < 1, start).otherwise(
            F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(a["w"], F.lit(1).cast("long"))), start, step))
        return F.coalesce(end["got"], a["m"])

    # an array of one, so that the arguments are computed once
    return F.transform(F.array(args), draw)[0]


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def _split(capacity: Column, here: Column, seed: int, *where: Column) -> Column:
    """Of shards with these capacities, how many rows each takes from ``here`` rows."""
    n = F.size(capacity)
    zero = F.lit(0).cast("long")
    start = F.struct(here.alias("rows"), F.aggregate(capacity, zero, lambda s, x: s + x).alias("rest"),
                     F.array().cast("array<bigint>").alias("taken"))

    def step(s: Column, i: Column) -> Column:
        cap = F.element_at(capacity, i)
        got = hypergeometric(cap, s["rest"] - cap, s["rows"], _uniform(F.lit(seed), *where, i))
        return F.transform(F.array(F.struct(s.alias("s"), cap.alias("c"), got.alias("n"))), lambda t: F.struct(
            (t["s"]["rows"] - t["n"]).alias("rows"), (t["s"]["rest"] - t["c"]).alias("rest"),
            F.concat(t["s"]["taken"], F.array(t["n"])).alias("taken")))[0]

    return F.aggregate(F.sequence(F.lit(1), n), start, step)["taken"]


def communication_matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """``counts`` (part long, rows long) to (part, taken array<long>): how many rows each
    partition sends to each shard, uniformly among all matrices that a shuffle can give.
    Shards take total / shards rows, the first ones one more."""
    spark = counts.sparkSession
    top = counts.agg(F.max("part"), F.sum("rows")).first()
    if top[0] is None:
        return spark.createDataFrame([], "part long, taken array<bigint>")
    levels, total = max(1, int(top[0]).bit_length()), int(top[1])
    sizes = (counts.select(F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), "part", "rows")
             .groupBy("level", F.expr(f"shiftright(part, {levels} - level)").alias("node")).agg(F.sum("rows").alias("rows")))
    sizes = store(sizes, "shard-sizes")
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    nodes = spark.range(1).select(F.lit(0).cast("long").alias("node"),
                                  F.array(*[F.lit(c).cast("long") for c in capacity]).alias("capacity"))
    for level in range(1, levels + 1):
        left = sizes.where(f"level = {level} AND node % 2 = 0").select((F.col("node") / 2).cast("long").alias("node"), F.col("rows").alias("here"))
        split = nodes.join(left, "node", "left").withColumn("here", F.coalesce("here", F.lit(0).cast("long")))
        taken = _split(F.col("capacity"), F.col("here"), seed, F.lit(level), F.col("node"))
        both = split.select("node", "capacity", taken.alias("first")).select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("first").alias("capacity")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("capacity", "first", lambda a, b: a - b).alias("capacity")))).alias("n"))
        nodes = store(both.select("n.node", "n.capacity").where("exists(capacity, x -> x > 0)"), "shard-level")
    return nodes.select(F.col("node").alias("part"), F.col("capacity").alias("taken"))


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 11) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard): a uniform
    shuffle into ``shards`` shards whose row counts differ by one at most.

    Nulls, empty texts, ties and repeated rows need no care: rows are dealt by their place, never
    by a value, so no key can be hot.  An empty table gives an empty result.  Columns named
    ``shard`` or ``slot`` are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = df.drop("shard", "slot")
    local = (rows.withColumn("_q_key", F.rand(seed)).sortWithinPartitions("_q_key").drop("_q_key")
             .withColumn("_q_row", F.monotonically_increasing_id()))
    base = store(local, "shard-rows").withColumn("_q_part", F.shiftright("_q_row", 33))
    counts = store(base.groupBy(F.col("_q_part").alias("part")).agg(F.count(F.lit(1)).alias("rows")), "shard-counts")
    matrix = communication_matrix(counts, shards, seed).select(
        F.col("part").alias("_q_part"),
        F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: F.aggregate(
            F.slice("taken", F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x)).alias("_q_ends"))
    number = F.col("_q_row").bitwiseAND(F.lit((1 << 33) - 1))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // (shards * BUCKET_ROWS)))
    dealt = (base.join(matrix, "_q_part")
             .withColumn("shard", F.size(F.filter("_q_ends", lambda e: e <= number)).cast("int"))
             .withColumn("_q_key", F.xxhash64(F.lit(seed + 1), F.col("_q_row")))
             .withColumn("_q_bucket", F.pmod(F.shiftright("_q_key", 20), F.lit(buckets)))
             .drop("_q_part", "_q_ends"))
    sizes = dealt.groupBy("shard", "_q_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("shard", "_q_bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("_q_bucket")) - F.col("n")).alias("_q_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "_q_bucket").orderBy("_q_key", "_q_row"))
    return (dealt.withColumn("_q_rank", rank).join(before, ["shard", "_q_bucket"])
            .withColumn("slot", F.col("_q_before") + F.col("_q_rank") - 1)
            .select(*rows.columns, "shard", "slot"))


SHARDS = 8


def op3_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 7, counts at most one apart (law ``rows``)."""
    text = F.coalesce("text", F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"))
    return (shuffle_into_shards(docs, SHARDS)
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))
