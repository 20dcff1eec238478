"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source gets a share of the budget in proportion to its weight, but no more than its
cap of epochs; what it can't take goes to the others in proportion, until no source is
above its cap. The fixed point is target = min(cap, level * weight). A source's documents are then repeated
floor(target / size) times, and in a seeded random order as many get one repetition more
as bring it to its target. That order is found by narrowing it to a bucket twice, so no
task sorts a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nimbusvec.llm.shared import WORD, column, own_name, small_table, spread_join, stored

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"
#: Bits of a document's random place that each narrowing step reads.
STEP_BITS = 12


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _placed(sources: DataFrame) -> DataFrame:
    """sources with their place in code point order, null last, from 0: ranges are sorted apart and their counts added up."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = own_name(sources, "none")
    dealt = sources.withColumn(none, F.col("source").isNull()).repartitionByRange(parts, none, "source").sortWithinPartitions(none, "source")
    at = F.monotonically_increasing_id()
    dealt, _ = stored(dealt.select(*sources.columns, F.shiftright(at, 33).alias("range"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("inside")), "ranges")
    before, starts = 0, []
    for r in dealt.groupBy("range").count().orderBy("range").collect():  # one row for each range
        starts.append((r["range"], before))
        before += r["count"]
    table = small_table(sources.sparkSession, starts, "range long, start long")
    return dealt.join(F.broadcast(table), "range").withColumn("place", F.col("start") + F.col("inside")).drop("range", "start", "inside")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sources (source, source_size), one row each, other columns go along: plus target, by weights dealt in code point order, null last.

    The level that targets rise to is raised in rounds: what the sources above their cap leave
    is shared among the others, until a round finds none above it. A round is two sums.
    """
    dealt = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    weighed, _ = stored(_placed(sources).withColumn("w", dealt).withColumn("cap", F.lit(float(epochs)) * F.col("source_size").cast("double")), "weighed")
    total = weighed.agg(F.coalesce(F.sum(F.col("source_size").cast("double")), F.lit(0.0))).first()[0]
    # nobody is above their cap at first
    level, above = None, F.lit(False)
    while True:
        capped, rest = weighed.agg(F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~above, F.col("w")))).first()
        if rest is None:  # every source is at its cap
            return weighed.select(*sources.columns, F.col("cap").alias("target"))
        then = (total - capped) / rest
        if level is not None and then <= level:
            break
        level, above = then, F.lit(then) * F.col("w") > F.col("cap")
    return weighed.select(*sources.columns, F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target"))


def _place(doc_id: Column, seed: str) -> Column:
    """A document's random place: 48 bits of the MD5 of seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")


def _up_to(sums: DataFrame, by: str, need: str) -> DataFrame:
    """sums (source, by, size) and need: of each source the last value of by that starts before need, and what it still needs there."""
    w = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    run = sums.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0))).where(F.col("before") < F.col(need))
    return run.groupBy("source").agg(F.max(F.struct(by, (F.col(need) - F.col("before")).alias("left"))).alias("m")).select("source", f"m.{by}", F.col("m.left").alias("left_" + by))


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """One row for each source of sizes (doc_id, source, size; a stored table): source_key, source_size, docs, target, whole, below, upto.

    times() reads off it how often the mix takes a document.
    """
    rows = sizes.select(_key(F.col("source")).alias("source"), "size", _place(F.col("doc_id"), seed).alias("place"))
    rows = rows.withColumn("b1", F.shiftright("place", 48 - STEP_BITS)).withColumn("b2", F.shiftright("place", 48 - 2 * STEP_BITS))
    made = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, epochs)
    made = made.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    made, _ = stored(made.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("source", _key(F.col("source"))), "plan")
    first = rows.groupBy("source", "b1").agg(F.sum("size").alias("size")).join(made.select("source", "need"), "source")
    cut1, _ = stored(_up_to(first, "b1", "need"), "cut1")
    second = rows.join(cut1, ["source", "b1"]).groupBy("source", "b2", "left_b1").agg(F.sum("size").alias("size"))
    cut2, _ = stored(_up_to(second, "b2", "left_b1"), "cut2")
    # rows of one place are taken together; a bucket holds about one in 2 ** 24 of a source's rows
    third = rows.join(cut2, ["source", "b2"]).groupBy("source", "place", "left_b2").agg(F.sum("size").alias("size"))
    w = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = third.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0))).where(F.col("before") + F.col("size") / 2 <= F.col("left_b2"))
    cut3 = last.groupBy("source").agg(F.max("place").alias("upto"))
    out = made.join(cut2.select("source", "b2"), "source", "left").join(cut3, "source", "left")
    below = F.coalesce(F.shiftleft("b2", 48 - 2 * STEP_BITS), F.lit(0))
    return stored(out.select(F.col("source").alias("source_key"), "source_size", "docs", "target", "whole", below.alias("below"), F.coalesce("upto", F.lit(-1)).alias("upto")), "cuts")[0]


def _key(source: Column) -> Column:
    """A source as a join key, null included."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def times(doc_id: Column, epochs: int, seed: str) -> Column:
    """How often the mix takes a document, on rows joined with plan()."""
    place = _place(doc_id, seed)
    more = (place < F.col("below")) | (place <= F.col("upto"))
    return F.least(F.col("whole") + more.cast("long"), F.lit(epochs).cast("long"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken.

    size: words of the text, none for a null or empty one. The budget is all sizes together.
    taken: size times the repetitions that the mix gives the row, at most epochs. A source
    comes within half a document of its target. A null source is a source, the last one;
    a source without words has the target 0. The same rows and seed give the same mix;
    repeated rows of one doc_id stay together. Other columns are not read; an empty table
    gives an empty one.
    """
    sizes = _sizes(docs, doc_id, text, source)
    out = spread_join(sizes.withColumn("source_key", _key(F.col("source"))), plan(sizes, weights, epochs, seed), ["source_key"], "docs")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times(F.col("doc_id"), epochs, seed)).alias("taken"))


def _sizes(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return stored(docs.select(column(doc_id).alias("doc_id"), column(source).cast("string").alias("source"), words(column(text)).alias("size")), "sizes")[0]


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """docs, columns unchanged, each row as often as the mix takes it. Rows without words are dropped: they add nothing."""
    cuts = plan(_sizes(docs, doc_id, text, source), weights, epochs, seed)
    kept = docs.where(column(text).rlike(WORD)).select(F.struct(*(column(c) for c in docs.columns)).alias("doc"), _key(column(source).cast("string")).alias("source_key"), column(doc_id).alias("doc_id"))
    taken = spread_join(kept, cuts, ["source_key"], "docs").withColumn("times", times(F.col("doc_id"), epochs, seed)).where("times > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("time")).select(*(F.col("doc")[c].alias(c) for c in docs.columns))
