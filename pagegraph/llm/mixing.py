"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are laid on a token line in a seeded shuffled order and cut into blocks of ``block``
tokens. Slot t of the schedule goes to the source that the golden-ratio point frac(t * phi) falls into when
sources are laid end to end by target. The slot's rank within its source names the block it takes, going round
the line again for repeats. Ranks past a source's target are not used, ranks that the points leave out follow as
tail slots, and the last block is cut at the target: a source gives its target to within a word, and the order
of slots is even at every scale. Nothing is drawn at random, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, table

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
BLOCK = 512
#: Hash ranges of a source's line (prefix sums are taken within, then over them), cells of the unit interval, slots per
#: chunk, chunks per stretch (their prefix sums are taken within stretches, then over them).
BUCKETS, CELLS, CHUNK, STRETCH = 4096, 4096, 1024, 1024
#: Fractional parts of the golden ratio and of 2^20 times it.
PHI = 0.6180339887498949
PHI_20 = (PHI * 2**20) % 1.0


def word_count(col):
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: source, source_size, target.

    Weights go round by the sources' code point order, null last. The total of all sizes is shared by weight;
    targets stop at ``most`` times the source's size and the excess goes to the others by weight. That fixed
    point is min(cap, weight * level); the level shows when going through the sources by cap / weight.
    The windows run over one row per source.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source at which the level is within its cap fixes it for all
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(whole)
    return s.select("source", "source_size", F.least("cap", F.col("weight") * first["level"]).alias("target"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots: source, rank, slot (null for tail slots), and the source's source_size and goal."""
    t = targets.withColumn("goal", F.round("target").cast("long")).where("goal > 0")
    nb = F.ceil(F.col("source_size") / block)
    t = t.withColumn("need", (F.floor(F.col("goal") / F.col("source_size")) * nb + F.ceil((F.col("goal") % F.col("source_size")) / block)).cast("long"))
    line = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumn("hi", F.sum("need").over(line)).withColumn("all", F.sum("need").over(whole)).withColumn("lo", F.col("hi") - F.col("need"))
    t = t.withColumn("key", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    cells = t.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS / F.col("all")), F.least(F.lit(CELLS - 1), F.floor(F.col("hi") * CELLS / F.col("all"))))))
    n = t.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    chunks = targets.sparkSession.range(-(-n // CHUNK)).select(F.col("id").alias("chunk"))
    slots = chunks.select("chunk", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.lit(n), (F.col("chunk") + 1) * CHUNK) - 1)).alias("slot"))
    point = F.pmod((F.col("slot") % 2**20) * F.lit(PHI) + F.pmod(F.floor(F.col("slot") / 2**20) * F.lit(PHI_20), F.lit(1.0)), F.lit(1.0))
    slots = slots.withColumn("u", point).withColumn("cell", F.floor(F.col("u") * CELLS))
    placed = slots.join(cells, "cell").where("u * all >= lo and u * all < hi").select("slot", "chunk", "key")
    # rank within the source: before this chunk, then within it
    per = placed.groupBy("key", "chunk").agg(F.count("*").alias("c")).withColumn("stretch", F.floor(F.col("chunk") / STRETCH))
    long = per.groupBy("key", "stretch").agg(F.sum("c").alias("s"))
    long = long.select("key", "stretch", F.coalesce(F.sum("s").over(W.partitionBy("key").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    own = F.coalesce(F.sum("c").over(W.partitionBy("key", "stretch").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("start", own).join(long, ["key", "stretch"]).withColumn("start", F.col("start") + F.col("_s"))
    ranked = placed.withColumn("r", F.row_number().over(W.partitionBy("key", "chunk").orderBy("slot")) - 1).join(per.select("key", "chunk", "start").hint("merge"), ["key", "chunk"])
    ranked = ranked.select("key", "slot", (F.col("start") + F.col("r")).alias("rank"))
    facts = t.select("key", "source_size", "goal", "need")
    got = per.groupBy("key").agg(F.sum("c").alias("c"))
    tail = facts.join(got, "key", "left").withColumn("c", F.coalesce("c", F.lit(0))).where("c < need")
    tail = tail.select("key", F.lit(None).cast("long").alias("slot"), F.explode(F.sequence(F.col("c"), F.col("need") - 1)).alias("rank"))
    return ranked.unionByName(tail).join(facts, "key").where("rank < need")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK, seed: int = 7, by: tuple[str, ...] = ("doc_id",), carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, size): these, ``by``, ``carry``, source_size, target, taken, first_slot.

    ``by`` shuffles a source's line: rows alike in these lie together; ``carry`` columns settle the order among them
    and come back with their row. ``taken`` counts the words that the mix takes from the document, repeats counted. Null
    sizes are 0; documents of size 0 have none. Rows that repeat a doc_id, or have none, keep places of their own on
    the line; which of several equal rows is where does not matter. A null source is one of its own, the last. Other
    columns are ignored. An empty table gives an empty result.
    """
    own = list(dict.fromkeys(["doc_id", *by, *carry]))
    docs = cut(docs.select(*own, "source", F.coalesce("size", F.lit(0)).cast("long").alias("size")))  # texts are read once
    targets = cut(source_targets(docs, weights, most))  # one row per source
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    line = docs.where("size > 0").withColumn("key", key).withColumn("_h", F.xxhash64(F.lit(seed), *by)).withColumn("_bucket", F.pmod("_h", F.lit(BUCKETS)))
    per = line.groupBy("key", "_bucket").agg(F.sum("size").alias("s"))
    per = per.withColumn("start", F.coalesce(F.sum("s").over(W.partitionBy("key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = W.partitionBy("key", "_bucket").orderBy("_h", *own, "size").rowsBetween(W.unboundedPreceding, -1)
    line = line.withColumn("w", F.coalesce(F.sum("size").over(within), F.lit(0))).join(per.select("key", "_bucket", "start").hint("merge"), ["key", "_bucket"])
    line = line.withColumn("lo", F.col("start") + F.col("w")).withColumn("hi", F.col("lo") + F.col("size")).select(*own, "source", "key", "size", "lo", "hi")
    pieces = line.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    nb = F.ceil(F.col("source_size") / block)
    slots = schedule(targets, block).withColumn("b", F.col("rank") % nb)
    left = F.col("goal") - F.floor(F.col("rank") / nb) * F.col("source_size")  # words still to take when this round of the line began
    slots = slots.select("key", "b", "slot", left.alias("upto"))
    overlap = F.greatest(F.lit(0), F.least(F.col("hi"), (F.col("b") + 1) * block, F.col("upto")) - F.greatest(F.col("lo"), F.col("b") * block))
    taken = pieces.join(slots.hint("merge"), ["key", "b"], "left").withColumn("o", F.when(F.col("upto").isNull(), 0).otherwise(overlap))
    taken = taken.groupBy(*own, "source", "size", "lo").agg(F.sum("o").cast("long").alias("taken"), F.min(F.when(F.col("o") > 0, F.col("slot"))).alias("first_slot")).drop("lo")
    out = taken.unionByName(docs.where("size = 0").select(*own, "source", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot")))
    facts = targets.withColumnRenamed("source", "_s")
    return out.join(facts, F.col("source").eqNullSafe(F.col("_s"))).select(*own, "source", "size", "source_size", "target", "taken", "first_slot")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
