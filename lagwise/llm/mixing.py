"""Mixing sources to target weights by systematic sampling.

Within a source every document is expected ``target / source_size`` times.  The
documents stand in a fixed order (binned by size, then by the MD5 of their id),
the expected copies are summed along it, one offset in [0, 1) taken from the MD5
of the source is added, and a document is emitted once for each integer that the
sum crosses.  As the order goes by size, the words taken telescope to the target.

Ranks come in two passes, so that no task holds a source: counts of (source, size
bin, leading digits of the MD5) are summed along the order, and rows are numbered
within these groups only.  The number of digits follows the largest bin.

Targets: every source's weight has its share of all words, none above
``max_repeat`` times its own, the excess shared by weight among the rest.  That is
min(cap, level * weight) with one level, found by a prefix sum over the sources.

Defined cases: null sources are one source, last in the order; null text or size
counts 0; sources without words have target 0 and none taken; repeated rows are
documents each; an empty table gives an empty table; other columns pass through,
names in ``ADDED`` are replaced by ``mix`` and kept as they are by ``sample``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, named

ADDED = ("size", "source_size", "target", "copies", "taken")
#: Rows to be numbered by one window at most, but for chance.
GROUP_ROWS = 4000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Orders by code point, null last, and never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def size_bin(size: Column) -> Column:
    """The four leading binary digits of a size and their place: bins an eighth wide."""
    shift = F.greatest(F.length(F.bin(size)) - 4, F.lit(0))
    return (shift * 16 + F.call_function("shiftright", size, shift)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeat: float = 3) -> DataFrame:
    """(__key, source_size) -> with target; a row for each source."""
    order = Window.orderBy("__key")  # a row for each source, summed before
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("__w", w).withColumn("__cap", F.col("source_size") * float(max_repeat)).withColumn("__q", F.col("__cap") / F.col("__w"))
    upto = Window.orderBy("__q", "__key").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy("__q", "__key").rowsBetween(1, Window.unboundedFollowing)
    s = s.withColumn("__capped", F.sum("__cap").over(upto)).withColumn("__left", F.coalesce(F.sum("__w").over(after), F.lit(0.0)))
    total = s.agg(F.sum("source_size").cast("double").alias("__total"), F.sum("__w").alias("__weights"))
    s = s.crossJoin(F.broadcast(total))  # one row
    full = F.col("__capped") + F.col("__q") * F.col("__left") <= F.col("__total")
    level = s.where(full & (F.col("__left") > 0)).agg(F.max(F.struct("__q", "__capped", "__left")).alias("x"))
    s = s.crossJoin(F.broadcast(level))  # one row
    even = F.col("__total") / F.col("__weights")
    rest = F.when(F.col("x").isNull(), even).otherwise((F.col("__total") - F.col("x.__capped")) / F.col("x.__left"))
    return s.select("__key", "source_size", F.least(F.col("__cap"), rest * F.col("__w")).alias("target"))


def mix(docs: DataFrame, size: Column, source_col: str = "source", id_col: str = "doc_id", weights: tuple[float, ...] = (1, 2, 3), max_repeat: float = 3) -> DataFrame:
    """``docs`` with size, source_size, target, copies (how often the mix takes the row) and taken (words)."""
    key, md5, bin_, part, rank = names = fresh(docs, "key", "md5", "bin", "part", "rank")
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.withColumns({key: source_key(F.col(source_col)), md5: digest, "size": F.coalesce(size, F.lit(0)).cast("long")})
    rows = rows.withColumn(bin_, size_bin(F.col("size")))
    largest = rows.groupBy(key, bin_).count().agg(F.max("count")).first()[0] or 1
    digits = max(0, math.ceil(math.log(largest / GROUP_ROWS, 16))) if largest > GROUP_ROWS else 0
    rows = rows.withColumn(part, F.substring(md5, 1, digits))

    place = [F.col(x).alias(y) for x, y in ((key, "__key"), (bin_, "bin"), (part, "part"))]
    groups = rows.select(*place, "size").groupBy("__key", "bin", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    along = Window.partitionBy("__key").orderBy("bin", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each group
    groups = groups.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
    sources = groups.groupBy("__key").agg(F.sum("words").alias("source_size"))
    groups = groups.join(targets(sources, weights, max_repeat), "__key")
    offset = F.conv(F.substring(F.md5(F.col("__key").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    before, offset_, rate_ = fresh(docs.select(*named(docs.columns), *(F.lit(0).alias(x) for x in names)), "before", "offset", "rate")
    groups = groups.select(
        F.col("__key").alias(key), F.col("bin").alias(bin_), F.col("part").alias(part), F.col("before").alias(before), offset.alias(offset_), rate.alias(rate_), "source_size", "target",
    )

    within = Window.partitionBy(key, bin_, part).orderBy(md5, id_col, "size")
    ranked = rows.drop("source_size", "target", "copies", "taken").withColumn(rank, F.row_number().over(within)).join(groups, [key, bin_, part])
    k = F.col(before) + F.col(rank)
    crossed = (F.floor(k * F.col(rate_) + F.col(offset_)) - F.floor((k - 1) * F.col(rate_) + F.col(offset_))).cast("long")
    # a rate of at most max_repeat crosses no more integers but by rounding
    out = ranked.withColumn("copies", F.least(crossed, F.lit(int(max_repeat)).cast("long"))).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop(*names, before, offset_, rate_)


def emit(mixed: DataFrame) -> DataFrame:
    """Every row as often as the mix takes it, without the columns that ``mix`` added."""
    (copy,) = fresh(mixed, "copy")
    taken = mixed.where(F.col("copies") > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.drop(copy, *ADDED)


def sample(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights: tuple[float, ...] = (1, 2, 3), max_repeat: float = 3) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: none, once or more.

    Ranks are taken of rows without text, told by id and a hash of id, source and text; rows that are equal in these
    share their copies evenly.
    """
    kid, rk, copies, same, number, copy = fresh(docs, "kid", "rk", "copies", "same", "number", "copy")
    told = {kid: F.coalesce(F.col(id_col).cast("string"), F.lit("")), rk: F.xxhash64(id_col, source_col, text_col)}
    slim = materialize(docs.select(*(c.alias(x) for x, c in told.items()), F.col(id_col).alias("id"), F.col(source_col).alias("of"), word_count(F.col(text_col)).alias("words")), "sizes")
    mixed = mix(slim, F.col("words"), "of", "id", weights, max_repeat).groupBy(kid, rk).agg(F.sum("copies").alias(copies), F.count("*").alias(same))
    mixed = materialize(mixed.where(F.col(copies) > 0), "copies")
    rows = docs.withColumns(told)
    once = rows.join(mixed.where(F.col(same) == 1), [kid, rk]).withColumn(number, F.col(copies))
    equal = Window.partitionBy(kid, rk).orderBy(rk)
    shared = lambda k: F.floor(k * F.col(copies) / F.col(same))
    several = rows.join(mixed.where(F.col(same) > 1), [kid, rk]).withColumn(number, F.row_number().over(equal))
    several = several.withColumn(number, (shared(F.col(number)) - shared(F.col(number) - 1)).cast("long"))
    both = once.unionByName(several).where(F.col(number) > 0)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(number).cast("long")))).select(*named(docs.columns))
