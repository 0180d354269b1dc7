"""Operator 9: mixing sources to target weights by golden-ratio points through cumulative weights. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch

#: Slots of a schedule (blocks get longer as the input grows), least slots of a source, buckets of a source's order.
SLOTS, FINEST, BUCKET_BITS = 1 << 18, 600, 12
#: 2**32 over the golden ratio: multiples modulo 2**32 are the points, exact in longs for up to 2**31 of them.
GOLDEN, ROUND = 2654435769, 1 << 32
#: Points deviate from an interval's share by some 4; a source's slots are not ranked beyond this many more than its share.
SLACK = 16
#: Cells in which a point looks up its source, and points of a stretch that is ranked by itself.
CELLS, STRETCH = 1 << 14, 1 << 12
WEIGHTS, REPEATS, SEED = (5, 2, 1), 3, 17


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(sid, source, source_size, target) from (source, source_size): all words shared by weight.

    Sources in code point order, null last, have the weights in turn. No target exceeds `repeats` times its
    source; the excess is shared again by weight among the others until none is above. In the order of
    limit/weight this is one comparison: the first source whose share of what the earlier ones leave is within
    its limit ends the row of the limited ones. The table has one row per source.
    """
    by_name = W.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("sid", F.row_number().over(by_name)).withColumn("w", weight).withColumn("most", repeats * F.col("source_size").cast("double"))
    order = W.orderBy(F.col("most") / F.col("w"), "sid")
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("before", F.sum("most").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("most"))
    s = s.withColumn("others", F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    s = s.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything) - F.col("before")) / F.col("others")).withColumn("place", F.row_number().over(order))
    s = s.withColumn("free", F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct("place", "level"))).over(everything))
    target = F.when(F.col("free").isNull() | (F.col("place") < F.col("free.place")), F.col("most")).otherwise(F.col("free.level") * F.col("w"))
    return s.select("sid", "source", "source_size", F.least(target, F.col("most")).alias("target"))


def blocked(targets: DataFrame, block: int) -> DataFrame:
    """The targets with `blocks`, into which a source is divided, and `slots`, how many of them the mix wants.

    Blocks have `block` words. A source whose target is below FINEST of them has shorter ones, so that the few slots by which
    points deviate are less than a hundredth of it. A source's blocks are equal to one word, so that no slot is lost on a short last one.
    """
    size = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("target") / FINEST)))
    t = targets.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / size))
    return t.withColumn("slots", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))


def schedule(plan: DataFrame, repeats: int = REPEATS, golden: int = GOLDEN) -> DataFrame:
    """(sid, rank, place, block): the slots of the mix; in the order of place, from 0 to 1, they are the mix.

    Point i is i * golden modulo 2**32. The sources' wanted slots, added up in order, cut the circle into intervals, and a point
    is a slot of the source in whose interval it lies; so any stretch of the mix has each source's share within a few slots.
    The r-th slot of a source takes its block r modulo their number. Slots that would take a block more than `repeats`
    times are left out. A source that wants fewer than FINEST slots (one word each) has exactly as many: surplus points
    are left out, missing ones are added at the end.
    """
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    p = plan.where("slots > 0").withColumn("all", F.sum("slots").over(everything))  # one row a source
    p = p.withColumn("hi_slots", F.sum("slots").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, W.currentRow)))
    bound = lambda c: F.floor(F.expr(f"CAST({c} AS DECIMAL(20, 0)) * {ROUND} / all"))
    p = p.withColumn("lo", bound("hi_slots - slots").cast("long")).withColumn("hi", bound("hi_slots").cast("long"))
    cells = p.where("lo < hi").withColumn("cell", F.explode(F.expr(f"sequence(lo div {ROUND // CELLS}, (hi - 1) div {ROUND // CELLS})"))).select("cell", "sid", "lo", "hi")
    points = p.limit(1).select(F.explode(F.expr("sequence(0L, all - 1)")).alias("i")).withColumn("x", F.pmod(F.col("i") * golden, F.lit(ROUND)))
    hit = points.withColumn("cell", F.expr(f"x div {ROUND // CELLS}")).join(cells, "cell").where("lo <= x AND x < hi").select("sid", "i").withColumn("stretch", F.expr(f"i div {STRETCH}"))
    # ranks in two steps: a source with most slots is not ranked in one task
    counts = hit.groupBy("sid", "stretch").agg(F.count("*").alias("n"))
    counts = counts.withColumn("first", F.sum("n").over(W.partitionBy("sid").orderBy("stretch").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n"))
    within = F.row_number().over(W.partitionBy("sid", "stretch").orderBy("i")) - 1
    ranked = hit.join(counts.select("sid", "stretch", "first"), ["sid", "stretch"]).select("sid", "i", (F.col("first") + within).alias("rank"))
    most = F.least(F.when(F.col("slots") < FINEST, F.col("slots")).otherwise(F.col("slots") + SLACK), F.col("blocks") * repeats)
    ranked = ranked.join(p.select("sid", "blocks", "all", most.alias("most")), "sid").where("rank < most").select("sid", "rank", (F.col("i") / F.col("all")).alias("place"), "blocks")
    have = counts.groupBy("sid").agg(F.sum("n").alias("have"))
    short = p.where(F.col("slots") < FINEST).join(have, "sid", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < slots")
    added = short.select("sid", F.explode(F.expr("sequence(have, slots - 1)")).alias("rank"), F.lit(1.0).alias("place"), "blocks")
    return ranked.union(added).select("sid", "rank", "place", F.pmod("rank", "blocks").alias("block"))


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pieces(sized: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(row, sid, block, words): the parts of documents that lie in each block of their source's shuffled order.

    Blocks that no slot can take are left out.

    A source's documents follow each other in hash order. Their places are prefix sums in two steps, over
    buckets of the hash and within each, so that a hot source does not meet in one task.
    """
    d = sized.where("size > 0").join(targets.select("sid", "source"), sized["source"].eqNullSafe(targets["source"])).select("row", "sid", "size", "doc_id", F.xxhash64(F.lit(seed), "doc_id", "size").alias("h"))
    d = d.withColumn("bucket", F.shiftright("h", 64 - BUCKET_BITS))
    sums = d.groupBy("sid", "bucket").agg(F.sum("size").alias("s"))
    sums = sums.withColumn("first", F.sum("s").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("s"))
    d = d.join(sums.select("sid", "bucket", "first"), ["sid", "bucket"])
    end = F.col("first") + F.sum("size").over(W.partitionBy("sid", "bucket").orderBy("h", "doc_id", "row").rowsBetween(W.unboundedPreceding, W.currentRow))
    d = d.withColumn("end", end).withColumn("begin", F.col("end") - F.col("size"))
    # block i begins at word i * source_size div blocks; decimals, as the product can exceed a long
    starts = lambda i: f"(CAST({i} AS DECIMAL(19, 0)) * source_size div blocks)"
    within = lambda x: f"((CAST({x} + 1 AS DECIMAL(19, 0)) * blocks - 1) div source_size)"
    d = d.join(targets.select("sid", "source_size", "blocks", "slots"), "sid").withColumn("from", F.expr(within("begin"))).withColumn("to", F.expr(f"least({within('end - 1')}, slots + {SLACK} - 1)")).where("`from` <= `to`")
    d = d.select("row", "sid", "begin", "end", "source_size", "blocks", F.explode(F.expr("sequence(`from`, `to`)")).alias("block"))
    return d.select("row", "sid", "block", F.expr(f"least(end, {starts('block + 1')}) - greatest(begin, {starts('block')})").alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, slots: int = SLOTS) -> DataFrame:
    """row, doc_id, source, size, source_size, target, taken: how many words the mix takes of each document.

    Null and empty texts: size 0, nothing taken. A null source is a source of its own, the last. A null doc_id
    and repeated rows are documents like others. An empty table gives no rows. Reruns agree: the order is that
    of a hash of doc_id and size (rows alike in both may change places, which changes no total).
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size")).withColumn("row", F.monotonically_increasing_id())
    sized = scratch.table(sized, "sized")
    targets = scratch.table(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats), "targets")
    total = int(targets.agg(F.sum("source_size")).first()[0] or 0)
    block = max(1, -(-total // slots))
    plan = scratch.table(blocked(targets, block), "plan")
    draws = schedule(plan, repeats).groupBy("sid", "block").agg(F.count("*").alias("draws"))
    taken = pieces(sized, plan).join(draws, ["sid", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("draws")).alias("taken"))
    named = sized.join(targets.drop("sid").withColumnRenamed("source", "of"), sized["source"].eqNullSafe(F.col("of"))).drop("of")
    return named.join(taken, "row", "left").select("row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents as often as the mix takes them (its share of a document's words, rounded), with their own columns.

    Null, empty and blank texts have no words and stay once. Rows alike in doc_id and number of words share what the mix
    takes of them. An empty table gives no rows.
    """
    taken = mix(docs, **how).where("size > 0").groupBy(F.col("doc_id").alias("__doc"), F.col("size").alias("__of")).agg(F.sum("taken").alias("__taken"), F.count("*").alias("__rows"))
    both = docs.withColumn("__size", word_count()).join(taken, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__size") == F.col("__of")), "left")
    times = F.when(F.col("__size") == 0, 1).otherwise(F.coalesce(F.round(F.col("__taken") / F.col("__rows") / F.col("__size")), F.lit(0))).cast("int")
    return both.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)
