"""Operator 10: mixing sources to target weights, in built-in functions only.

Documents are hashed into permuted blocks of their source. The target of a source is met by whole passes over its
blocks plus a partial pass over the first of them; the last block of that pass is cut at a document. The drawn
blocks are dealt to output shards by a splitting tree: a node halves its block quotas by a multivariate
hypergeometric draw, so each shard holds a fair random share of every source and no block goes to two shards.
Block tables hold at most BLOCKS rows per source, however many documents there are; tables of sources are gathered in
one row or task, so sources are thought to be many thousands at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.llm.common import cut, let, table, words

WEIGHTS = (5.0, 2.0, 1.0)
BLOCKS = 1024
#: A table of blocks is broadcast if it has at most so many rows, of some 200 bytes; else it is joined by a shuffle.
MOST_FACTS = 100_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) with target: share of all words by weight, at most `most` times the source's size.

    Weights repeat along the sources by code point, null last. Excess is reshared by weight until no source is above:
    filling by the level at which a source is full gives that fixed point in one pass over the sorted sources.
    """
    level, everything = Window.orderBy("full_at", "rank"), Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    t = t.withColumn("left", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("lambda", F.col("left") / F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("lambda", F.min(F.when(F.col("full_at") > F.col("lambda"), F.struct("full_at", "lambda"))).over(everything)["lambda"])
    return t.select("source", "source_size", F.least("cap", F.coalesce(F.col("lambda") * F.col("weight"), F.col("cap"))).alias("target"))


def _hypergeometric(n: Column, k: Column, m: Column, u: Column) -> Column:
    """How many of k marked of n units are among m drawn, by inversion of u.

    Weights relative to the mode follow from the ratio of neighbours; beyond ten standard deviations they are nothing.
    """

    def draw(x: Column) -> Column:
        n, k, m = x["n"], x["k"], x["m"]
        mode = F.floor((m + 1) * (k + 1) / (n + 2))
        reach = F.ceil(10 * F.sqrt(m * k / F.greatest(n, F.lit(1)))) + 10
        low = F.greatest(F.lit(0).cast("long"), m - (n - k), mode - reach)
        high = F.least(m, k, mode + reach)
        up = lambda i: (k - i) * (m - i) / ((i + 1) * (n - k - m + i + 1))
        none = F.array().cast("array<bigint>")
        grow = lambda ratio: lambda a, i: F.struct((a["w"] * ratio(i)).alias("w"), (a["s"] + a["w"] * ratio(i)).alias("s"))
        one = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
        down = F.aggregate(F.when(low < mode, F.sequence(mode - 1, low)).otherwise(none), one, grow(lambda i: 1 / up(i)))
        above = F.aggregate(F.when(mode < high, F.sequence(mode, high - 1)).otherwise(none), one, grow(up))
        pick = lambda y: F.aggregate(
            F.when(low < high, F.sequence(low, high - 1)).otherwise(none),
            F.struct(low.alias("x"), y["w"].alias("w"), y["w"].alias("s")),
            lambda a, i: F.struct(
                F.when(a["s"] < y["t"], i + 1).otherwise(a["x"]).alias("x"), (a["w"] * up(i)).alias("w"), (a["s"] + a["w"] * up(i)).alias("s")
            ),
            lambda a: a["x"],
        )
        return let(F.struct(down["w"].alias("w"), ((1 + down["s"] + above["s"]) * x["u"]).alias("t")), pick)

    return let(F.struct(n.cast("long").alias("n"), k.cast("long").alias("k"), m.cast("long").alias("m"), u.alias("u")), draw)


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas (src, quota) as (src, shard, first, last): the ranks of each source's units that a shard gets.

    A node of an odd number of shards gives the larger part of them, and units in proportion, to its left side. The tree
    is a table of one row per node with the quotas as an array.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("src", "quota"))).alias("q")).select(
        F.transform("q", lambda x: x["src"]).alias("src"), F.transform("q", lambda x: x["quota"]).alias("q"), F.lit(0).alias("shard"), F.lit(shards).alias("width")
    )
    wide = F.ceil(F.col("width") / 2).cast("int")  # of the left side
    total = lambda q: F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x)
    for depth in range((shards - 1).bit_length()):

        def step(a: Column, x: Column) -> Column:
            u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(depth), F.col("shard"), F.size(a["out"])), F.lit(2**52)) + 0.5) / 2**52  # noqa: B023
            drawn = _hypergeometric(a["n"], x, a["m"], u)
            return let(drawn, lambda d: F.struct((a["n"] - x).alias("n"), (a["m"] - d).alias("m"), F.concat(a["out"], F.array(d)).alias("out")))

        start = F.struct(total(F.col("q")).alias("n"), F.ceil(total(F.col("q")) * wide / F.col("width")).alias("m"), F.array().cast("array<bigint>").alias("out"))
        left = let(F.aggregate("q", start, step, lambda a: a["out"]), lambda x: F.array(x, F.zip_with("q", x, lambda p, r: p - r)))
        node = node.select("src", "shard", "width", F.posexplode(left).alias("side", "q"))
        node = node.select("src", "q", (F.col("shard") + F.col("side") * wide).alias("shard"), F.when(F.col("side") == 0, wide).otherwise(F.col("width") - wide).alias("width")).where("width > 0")
    parts = node.select("shard", F.explode(F.arrays_zip("src", "q")).alias("x")).select("shard", "x.src", "x.q")
    last = F.sum("q").over(Window.partitionBy("src").orderBy("shard"))
    return parts.select("src", "shard", (last - F.col("q") + 1).alias("first"), last.alias("last"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, shards: int = 16,
    seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", also: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, draws (array of pass and shard), taken and also, a row per input row.

    also names columns of docs to carry along, such as the text. A null or empty text has size 0. A null source is a source of its own, the last. Rows with the same id and source,
    a null id too, are drawn together, each with its own size. A source of size 0 has target 0. Other columns are dropped. An empty
    table gives an empty table. The draw depends on ids, sources, sizes and seed alone, so reruns agree.
    """
    src = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"), *[F.col(c).alias(f"also_{c}") for c in also])
    d = d.withColumn("src", src).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "src"), F.lit(BLOCKS)).cast("int"))
    whole = d.withColumn("at", F.xxhash64(F.lit(seed + 1), "doc_id", "src"))
    d = cut(whole.drop(*[f"also_{c}" for c in also]))
    whole = whole if also else d

    blocks = cut(d.groupBy("src", "source", "block").agg(F.sum("size").alias("words")))
    goal = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = cut(goal.withColumn("src", src).withColumn("passes", passes.cast("int")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).drop("source"))

    along = Window.partitionBy("src").orderBy("block")
    b = blocks.drop("source").join(goal, "src").withColumn("end", F.sum("words").over(along)).withColumn("begin", F.col("end") - F.col("words"))
    b = cut(b.withColumn("cut", (F.col("begin") < F.col("rest")) & (F.col("rest") < F.col("end"))))

    # the document at which a block is cut: by sums over ranges of hashes first, so that a window sees a small part of it
    edge = d.join(F.broadcast(b.where("cut").select("src", "block", (F.col("rest") - F.col("begin")).alias("room"))), ["src", "block"])  # a row per source at most
    edge = edge.groupBy("src", "at").agg(F.sum("size").alias("size"), F.first("room").alias("room"))
    edge = cut(edge.withColumn("part", F.shiftright("at", 54)))
    parts = edge.groupBy("src", "part").agg(F.sum("size").alias("words"), F.max("at").alias("top"), F.first("room").alias("room"))
    parts = parts.withColumn("stop", F.sum("words").over(Window.partitionBy("src").orderBy("part"))).withColumn("start", F.col("stop") - F.col("words"))
    inner = edge.drop("room").join(parts.where("start <= room AND room < stop").select("src", "part", "room", "start"), ["src", "part"])
    before = F.col("start") + F.sum("size").over(Window.partitionBy("src", "part").orderBy("at")) - F.col("size")
    inner = inner.withColumn("fits", before + F.col("size") / 2 <= F.col("room")).where("fits").select("src", F.col("at").alias("top"))
    edge = parts.where("stop <= room").select("src", "top").unionByName(inner).groupBy("src").agg(F.max("top").alias("last_at"))

    n = F.col("passes") + F.when(F.col("begin") < F.col("rest"), 1).otherwise(0)
    units = b.withColumn("pass", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)))).withColumn("partly", F.col("cut") & (F.col("pass") > F.col("passes")))
    units = units.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("pass", F.xxhash64(F.lit(seed + 2), "pass", "block"))))
    units = cut(units.select("src", "block", "pass", "partly", "rank"))
    tree = splitting_tree(units.groupBy("src").agg(F.count("*").alias("quota")), shards, seed)
    tree = tree.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("last", "shard"))).alias("ends"))
    shard = F.get(F.filter("ends", lambda e: e["last"] >= F.col("rank")), F.lit(0))["shard"]
    drawn = units.join(tree, "src").withColumn("draw", F.struct("pass", shard.alias("shard"), "partly"))
    drawn = drawn.groupBy("src", "block").agg(F.sort_array(F.collect_list("draw")).alias("draws"))

    facts = cut(b.select("src", "block", "source_size", "target").join(edge, "src", "left").join(drawn, ["src", "block"], "left"))
    facts = F.broadcast(facts) if facts.count() <= MOST_FACTS else facts
    mine = F.filter(F.coalesce("draws", F.array().cast(drawn.schema["draws"].dataType)), lambda x: ~x["partly"] | F.coalesce(F.col("at") <= F.col("last_at"), F.lit(False)))
    out = whole.join(facts, ["src", "block"], "left").withColumn("draws", F.transform(mine, lambda x: F.struct(x["pass"].alias("pass"), x["shard"].alias("shard"))))
    return out.select("doc_id", "source", "size", "source_size", "target", "draws", (F.col("size") * F.size("draws")).alias("taken"), *[F.col(f"also_{c}").alias(c) for c in also])


def shuffled(mixed: DataFrame, seed: int = 7) -> DataFrame:
    """A row per draw, with pass, shard and place instead of draws; dealt out by shard, and within it in permuted order.

    place is a hash of the draw, so rows sorted by (shard, place) are in the order of the mix. Documents without a draw
    give no row.
    """
    rows = mixed.select(*[c for c in mixed.columns if c != "draws"], F.explode("draws").alias("draw"))
    rows = rows.select(*[c for c in mixed.columns if c != "draws"], "draw.*").withColumn("place", F.xxhash64(F.lit(seed), "pass", "doc_id", "source"))
    return rows.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")


def write_shards(mixed: DataFrame, path: str, seed: int = 7) -> None:
    """Writes shuffled(mixed), partitioned by shard."""
    shuffled(mixed, seed).write.partitionBy("shard").parquet(path)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
