"""Mixing sources to target weights by capped water-filling and seeded sampling.

Sources (ordered by code point, null last) weigh ``weights`` in turn and share the budget, all words
of all documents. A source's target stops at ``max_epochs`` times its own words; what it gives up is
dealt to the others by weight, round after round, until no target is above its cap. A document is
repeated ``floor(target / source words)`` times; the fraction left is met by taking documents in a
seeded random order until the next one would overshoot by more than half its size. So the taken words
differ from the target by less than one document, reruns agree, and no document exceeds the cap.

Scale: two aggregations by source with partial sums, water-filling by aggregates of the source table
(one row to the driver per round), and no ordering of a whole source: documents fall into
ranges of their draw, a running sum over the ranges of a source finds the one where its goal lies, that
range is cut again until it holds at most ``EDGE_ROWS`` documents, and only these are ordered. Rows of equal
draw, id and size count as one line with a number; if only a part of them fits, they are numbered by
partition.

Defined results: a null text has size 0; documents of size 0 are never taken more than the
whole repetitions of their source; documents with equal ``doc_id`` share one draw, ties are taken by
size, and of rows equal in id and size as many as fit (which ones is not defined beyond that); a source
without words gets target 0; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantlog.llm.common import WORD, saved

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 17
#: Draws are dealt by so many bits at a time until the edge of every source has at most so many rows.
BUCKET_BITS, EDGE_ROWS = 10, 100_000
#: 13 hex digits of a digest: below 2**52, exact in any engine.
_DRAW_DIGITS = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A seeded uniform number of ``_DRAW_DIGITS`` hexadecimal digits per document."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key), 1, _DRAW_DIGITS), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``: the position (from 0) by code point, null last. Ranges of names
    are numbered apart; the driver sees one count per range."""
    spread = saved(sources.withColumn("missing", F.col("source").isNull()).repartitionByRange(
        "missing", "source").withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = sorted(spread.groupBy("part").count().collect())
    before, total = {}, 0
    for part, n in counts:
        before[part], total = total, total + n
    if not before:
        return spread.select("source", "source_size", F.lit(0).cast("long").alias("place"))
    start = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("part")]
    w = Window.partitionBy("part").orderBy("missing", "source")
    return spread.select("source", "source_size", (
        start + F.row_number().over(w) - 1).cast("long").alias("place"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to (``source``, ``source_size``)."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.col("place") % len(weights) + 1).cast("int"))
    table = ranked(sources).withColumn("weight", weight.cast("double")).withColumn(
        "cap", (F.col("source_size") * max_epochs).cast("double"))
    table = saved(table, "mix-ranked")
    budget = float(table.agg(F.sum("source_size")).first()[0] or 0)
    # A level is the target of a source of weight 1. It only rises: a source once at its cap stays.
    level = 0.0
    while True:
        full = F.col("weight") * level >= F.col("cap")
        held, free = table.agg(F.sum(F.when(full, F.col("cap"))),
                               F.sum(F.when(~full, F.col("weight")))).first()
        if not free:
            break
        risen = (budget - (held or 0.0)) / free
        if risen <= level:
            break
        level = risen
    return table.select("source", "source_size", F.least(
        F.col("weight") * level, F.col("cap")).alias("target"))


def plan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source",
         weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``row`` (all its columns), ``size``, ``source_size``, ``target``
    and ``repeats``, the number of times the mix takes it."""
    sized = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"),
                        word_count(F.col(text)).alias("size"),
                        draw(F.col(doc_id), seed).alias("draw"),
                        F.col(doc_id).alias("tie"))
    narrow = sized.select("source", "size", "draw", "tie")
    narrow = saved(narrow, "mix-sizes")
    table = saved(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")),
                          weights, max_epochs), "mix-targets")
    rate = F.col("target") / F.col("source_size")
    whole = F.when(F.col("source_size") > 0, F.floor(rate)).otherwise(0)
    table = table.withColumn("whole", whole.cast("long")).withColumn(
        "goal", F.when(F.col("source_size") > 0, (rate - whole) * F.col("source_size")).otherwise(0.0))

    # The edge of a source: the range of draws where its goal lies, cut finer until it holds few rows.
    few, shift, share = _few(table), 4 * _DRAW_DIGITS, lambda t: F.broadcast(t) if few else t
    table = table.withColumn("edge", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long"))
    rows, wide = narrow, True
    while wide and shift > 0:
        parent, shift = shift, max(shift - BUCKET_BITS, 0)
        rows = rows.alias("n").join(share(table).alias("t"), F.col("n.source").eqNullSafe(F.col("t.source")) & (
            F.shiftright("draw", parent) == F.col("edge"))).select("n.*")
        sums = rows.groupBy("source", F.shiftright("draw", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.count("*").alias("rows"))
        w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("ahead", F.coalesce(F.sum("words").over(w), F.lit(0)))
        # Null is a source of its own here: joins compare it with <=>.
        marks = sums.alias("s").join(share(table).alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).where(
            F.col("before") + F.col("ahead") < F.col("goal")).groupBy("t.source").agg(
            F.max("bucket").alias("edge"), F.max_by("ahead", "bucket").alias("ahead"), F.max_by("rows", "bucket").alias("rows"))
        marks = saved(marks, "mix-edges")
        table = saved(table.alias("t").join(marks.alias("m"), F.col("t.source").eqNullSafe(F.col("m.source")), "left").select(
            "t.source", "source_size", "target", "whole", "goal", F.coalesce("m.edge", F.lit(-1)).cast("long").alias("edge"),
            (F.col("before") + F.coalesce("ahead", F.lit(0))).alias("before")), "mix-marks")
        wide = bool(marks.where(F.col("rows") > EDGE_ROWS).limit(1).count())

    # Equal rows are one line with a count, so that a part of them can be taken.
    inside = rows.alias("n").join(share(table).alias("t"), F.col("n.source").eqNullSafe(F.col("t.source")) & (
        F.shiftright("draw", shift) == F.col("edge"))).groupBy("t.source", "draw", "tie", "n.size", "goal", "before").count()
    order = Window.partitionBy("source").orderBy("draw", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    running = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("count")).over(order), F.lit(0))
    fits = F.when(F.col("size") == 0, F.col("count")).otherwise(F.least(F.col("count"), F.floor(
        (F.col("goal") - F.col("running") - F.col("size") / 2) / F.col("size")) + 1))
    last = inside.select("*", running.alias("running")).where(F.col("running") + F.col("size") / 2 <= F.col("goal")).select(
        "source", F.struct("draw", "tie", "size").alias("here"), "count", fits.cast("long").alias("fits")).groupBy("source").agg(
        F.max("here").alias("last"), F.max_by("fits", "here").alias("fits"), F.max_by("count", "here").alias("count"))
    table = saved(table.alias("t").join(last.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left").select(
        "t.*", "last", "fits", (F.coalesce("fits", F.lit(0)) < F.coalesce("count", F.lit(0))).alias("torn")), "mix-last")

    bucket, here = F.shiftright("draw", shift), F.struct("draw", "tie", F.col("n.size").alias("size"))
    extra = F.when(bucket < F.col("edge"), 1).when((bucket == F.col("edge")) & (here <= F.col("last")), 1).otherwise(0)
    tied = F.col("torn") & F.coalesce((bucket == F.col("edge")) & (here == F.col("last")), F.lit(False))
    judged = sized.alias("n").join(share(table).alias("t"), F.col("n.source").eqNullSafe(F.col("t.source"))).select(
        "row", "t.source", "n.size", "source_size", "target", "whole", "fits", F.coalesce(extra, F.lit(0)).alias("extra"), tied.alias("tied"))
    result = lambda df, more: df.select("row", "size", "source_size", "target", (
        F.col("whole") + more).cast("long").alias("repeats"))
    if not table.where("torn").limit(1).count():
        return result(judged, F.col("extra"))
    # Of equal rows at the edge the first ``fits`` are taken, numbered by file partition.
    equal = saved(judged.where("tied").withColumn("part", F.spark_partition_id()), "mix-ties")
    counts = equal.groupBy("source", "part").count()
    ahead = F.sum("count").over(Window.partitionBy("source").orderBy("part")) - F.col("count")
    counts = saved(counts.select(F.col("source").alias("from"), F.col("part").alias("p"), ahead.alias("ahead")), "mix-tie-counts")
    numbered = equal.withColumn("i", F.row_number().over(Window.partitionBy("source", "part").orderBy(F.lit(0)))).join(
        counts, F.col("source").eqNullSafe(F.col("from")) & (F.col("part") == F.col("p")))
    return result(judged.where("NOT tied"), F.col("extra")).union(
        result(numbered, (F.col("ahead") + F.col("i") <= F.col("fits")).cast("int")))


def _few(table: DataFrame, limit: int = 100_000) -> bool:
    """Narrow source rows that every executor can hold; beyond that AQE's skew join takes over."""
    return table.limit(limit + 1).count() <= limit


def sample(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``plan`` says."""
    taken = plan(docs, **options)
    return taken.where("repeats > 0").select("row", F.explode(F.sequence(
        F.lit(1), F.col("repeats").cast("int")))).select("row.*")
