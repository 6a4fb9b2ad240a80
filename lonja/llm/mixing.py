"""Mixing sources to target weights by hash-threshold histograms.

Targets
    ``share`` times the sum of all sizes is divided over the sources by weight. A source that would get more than
    ``most`` times its own size stops there and the excess is reshared by weight, until none is above: target = min(most *
    size, level * weight), where the level rises from round to round and each round is one aggregate over the sources.

Choice
    A source takes each document ``floor(target / size)`` times, and once more those whose hash is at most a threshold.
    Sizes are summed by source and hash bucket; running sums over a source's buckets find the one bucket that its budget
    ends in; only that bucket is summed again with finer buckets, until it holds one hash value. Documents are then
    filtered by their hash: nothing is sorted, and a source that holds a third of all rows is pre-aggregated like any
    other. The last hash value is taken if its middle lies within the budget.

Edge cases
    Null text has size 0. Null ``source`` is a source, the last in order. Documents of equal ``doc_id`` share a hash and
    are taken together; null ids count as one id. Sizes that are all zero give targets of zero. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.llm.store import Scratch
from lonja.llm.tables import pick

#: Bits of the hash and of a histogram level.
HASH_BITS, LEVEL_BITS = 60, 12
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """The first 15 hexadecimal digits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def _ordered(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``position`` of each source from 0 by code point, null last, without sorting all in one task."""
    order = F.col("source").asc_nulls_last()
    dealt = sources.repartitionByRange(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), order)
    dealt = scratch.write(dealt.withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return dealt.withColumn("within", within).join(base, "part").select("source", "source_size", (F.col("base") + F.col("within") - 1).alias("position"))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sources(source, source_size, position)`` with ``target``; weights repeat in order of position."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(most))
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        free = F.col("most") >= F.lit(level) * F.col("weight")
        fixed, open_weight = weighed.agg(F.sum(F.when(~free, F.col("most"))), F.sum(F.when(free, F.col("weight")))).first()
        after = (total - (fixed or 0.0)) / open_weight if open_weight else level
        if after <= level:
            return weighed.select("source", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target"))
        level = after


def _thresholds(sized: DataFrame, budgets: DataFrame, scratch: Scratch) -> DataFrame:
    """``(source, threshold)``: hashes up to the threshold fit the source's ``budget``."""
    shift, level = HASH_BITS, 0
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), F.lit(-1).cast("long").alias("threshold"))
    settled = []
    while shift > 0:
        parent, shift = shift, shift - LEVEL_BITS
        bucket = F.shiftright("hash", shift)
        own = sized.alias("d").join(state.alias("s"), F.expr(f"d.source <=> s.source and shiftright(d.hash, {parent}) = s.prefix"))
        sums = own.groupBy("s.source", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("earlier", F.coalesce(F.sum("size").over(run), F.lit(0)))
        marked = sums.alias("h").join(state.alias("s"), F.expr("h.source <=> s.source")).selectExpr(
            "s.source", "budget", "threshold", "h.bucket", "h.size", "low", "high", "before + earlier as before", "before + earlier + h.size <= budget as fits"
        )
        cut = F.expr("struct(bucket, size, low, high, before)")
        found = marked.groupBy("source", "budget", "threshold").agg(
            F.max(F.when(F.col("fits"), F.col("bucket"))).alias("full"), F.min(F.when(~F.col("fits") & (F.col("before") < F.col("budget")), cut)).alias("cut")
        )
        # A whole bucket raises the threshold to its end; the bucket in which the budget ends, to just before its start.
        found = found.withColumn("threshold", F.expr(f"greatest(threshold, coalesce(shiftleft(full + 1L, {shift}) - 1, threshold), coalesce(shiftleft(cut.bucket, {shift}) - 1, threshold))"))
        found = scratch.write(found, f"level-{level}")
        one = F.col("cut.low") == F.col("cut.high")
        last = F.when(one & F.expr("2 * cut.before + cut.size <= 2 * budget"), F.col("cut.high")).otherwise(F.col("threshold"))
        settled.append(found.where(F.col("cut").isNull() | one).select("source", last.alias("threshold")))
        state = found.where(F.col("cut").isNotNull() & ~one).selectExpr("source", "budget", "cut.bucket as prefix", "cut.before as before", "threshold")
        level += 1
        if state.isEmpty():
            break
    return reduce(DataFrame.union, settled)


def plan_mix(docs: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Per document ``doc_id, source, size, source_size, target, copies``."""
    sized = pick(docs, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("hash"))
    sized = scratch.write(sized, "sizes")
    sources = _ordered(sized.groupBy("source").agg(F.sum("size").alias("source_size")), scratch)
    aims = scratch.write(targets(sources, weights, share, most), "targets")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = aims.withColumn("full", full).withColumn("budget", F.col("target") - F.col("full") * F.col("source_size"))
    limits = _thresholds(sized.where("size > 0"), aims.where("budget > 0").select("source", "budget"), scratch)
    plan = aims.alias("a").join(limits.alias("t"), F.expr("a.source <=> t.source"), "left").selectExpr("a.source as s", "source_size", "target", "full", "coalesce(threshold, -1) as threshold")
    return sized.join(plan, F.expr("source <=> s")).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("full") + (F.col("hash") <= F.col("threshold")).cast("long")).alias("copies")
    )


def mix(docs: DataFrame, scratch: Scratch, **options: object) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken``; ``taken`` counts repeated words each time."""
    return plan_mix(docs, scratch, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, scratch: Scratch, **options: object) -> DataFrame:
    """The rows of the mix with all their columns; a row taken several times stands several times."""
    plan = plan_mix(docs, scratch, **options).where("copies > 0").select("doc_id", "source", "copies").distinct()
    taken = docs.alias("d").join(plan.alias("p"), F.expr("d.doc_id <=> p.doc_id and d.source <=> p.source"))
    rows = taken.select(F.struct("d.*").alias("row"), F.explode(F.expr("sequence(1L, p.copies)")).alias("copy"))
    return rows.select("row.*")
