"""Ordered-sequence operators: islands, sessions, gap filling, ranks. All windows are partitioned by the caller's keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliqua.session import materialize


def islands(df: DataFrame, keys: Sequence[str], pos: str, name: str = "island") -> DataFrame:
    """df with the id of each run of consecutive positions (distinct by key)."""
    return df.withColumn(name, F.col(pos) - F.row_number().over(Window.partitionBy(*keys).orderBy(pos)))


def value_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, least: int = 1) -> DataFrame:
    """Runs of equal neighbouring values: keys, value, start and stop (by the first order column), size >= least."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order))
    out = df.withColumn("_run", same).groupBy(*keys, value, "_run").agg(F.min(order[0]).alias("start"), F.max(order[0]).alias("stop"), F.count(F.lit(1)).alias("size"))
    return out.filter(F.col("size") >= least).drop("_run")


def sessions(df: DataFrame, keys: Sequence[str], pos: str, gap: float, more_than: float = 0, name: str = "session") -> DataFrame:
    """Rows numbered by session: a gap over `gap` to the row before starts one; sessions of at most more_than rows go."""
    w = Window.partitionBy(*keys).orderBy(pos)
    new = F.when(F.col(pos) - F.lag(pos).over(w) <= gap, 0).otherwise(1)
    numbered = df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    sized = numbered.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*keys, name)))
    return sized.filter(F.col("_size") > more_than).drop("_size")


def modal(df: DataFrame, keys: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """The commonest value by key; of equally common ones the least."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))["v"].alias(name))


def start_converter(df: DataFrame, keys: Sequence[str], pos: str, gap: float = 5, more_than: float = 5) -> DataFrame:
    """keys, pos, start: every position of a large enough session, and the session's commonest position."""
    s = sessions(df, keys, pos, gap, more_than)
    return s.select(*keys, pos, "session").distinct().join(modal(s, [*keys, "session"], pos, "start"), [*keys, "session"]).drop("session")


def fill_gaps(loci: DataFrame, keys: Sequence[str], pos: str = "pos", near: int = 10, far: int = 20, around: int = 11, enough: int = 8) -> DataFrame:
    """Positions (keys, pos) with gaps filled: gaps shorter than `near`, then those up to `far` between dense stretches.

    Dense: at least `enough` positions among the `around` before the gap's left end, and as many after its right end.
    """
    def filled(df: DataFrame, wanted: Column) -> DataFrame:
        more = df.filter(wanted & (F.col("_next") - F.col(pos) > 1)).select(*keys, F.explode(F.sequence(F.col(pos) + 1, F.col("_next") - 1)).alias(pos))
        return df.select(*keys, pos).union(more).distinct()

    w = Window.partitionBy(*keys).orderBy(pos)
    one = filled(loci.select(*keys, pos).distinct().withColumn("_next", F.lead(pos).over(w)), F.col(pos) + near > F.col("_next"))
    right = F.count(F.lit(1)).over(w.rangeBetween(1, around))
    two = one.withColumn("_next", F.lead(pos).over(w)).withColumn("_left", F.count(F.lit(1)).over(w.rangeBetween(-around, -1))).withColumn("_own", right)
    two = two.withColumn("_right", F.lead("_own").over(w))
    return filled(two, (F.col(pos) + far >= F.col("_next")) & (F.col("_left") >= enough) & (F.col("_right") >= enough))


def count_in_range(df: DataFrame, keys: Sequence[str], pos: str, low: int, high: int, name: str = "n") -> DataFrame:
    """df with how many rows of the key lie from low to high places off."""
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(pos).rangeBetween(low, high)))


def centred(df: DataFrame, keys: Sequence[str], pos: str, value: str, width: int = 11, name: str = "window") -> DataFrame:
    """df with the values of the `width` rows around each; zeros where the window isn't full."""
    half = width // 2
    w = Window.partitionBy(*keys).orderBy(pos)
    got = F.collect_list(value).over(w.rowsBetween(-half, width - half - 1))
    return df.withColumn(name, F.when(F.size(got) == width, got).otherwise(F.array_repeat(F.lit(0.0), width)))


def look_ahead(df: DataFrame, keys: Sequence[str], pos: str, value: str, length: int = 10, name: str = "ahead") -> DataFrame:
    """df with the values of the row and those after it, `length` in all."""
    return df.withColumn(name, F.collect_list(value).over(Window.partitionBy(*keys).orderBy(pos).rowsBetween(0, length - 1)))


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank", start: int = 1) -> DataFrame:
    """df with numbers from `start` on in this order over all rows, without a task that gets them all.

    Rows are dealt by ranges and numbered within their part; what a part's numbers begin with is a sum over the parts.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = materialize(sorted_.select("*", F.spark_partition_id().alias("_part"), within.alias("_k")), "ranked")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a part
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, (F.col("_before") + F.col("_k") + start).cast("int")).drop("_part", "_k", "_before")


def dense_label(df: DataFrame, order: Sequence[Column], name: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """df with labels 1..n by the order of the groups; the groups' values, not their rows, are ranked."""
    tagged = df.withColumn("_o", F.struct(*[c.alias(f"c{k}") for k, c in enumerate(order)]))
    groups = tagged.select(*keys, "_o").distinct()
    found = groups.withColumn(name, F.dense_rank().over(Window.partitionBy(*keys).orderBy("_o")).cast("int")) if keys else ranked(groups, [F.col("_o")], name)
    return tagged.drop(name).join(found, [*keys, "_o"]).drop("_o")


def relabel_by_appearance(df: DataFrame, label: str, order: str, start: int = 1) -> DataFrame:
    """Labels renumbered from `start` in the order in which they first appear."""
    first = df.groupBy(label).agg(F.min(order).alias("_first"))
    return df.join(ranked(first, [F.col("_first")], "_new", start).drop("_first"), label).drop(label).withColumnRenamed("_new", label)


def overlapping_dropped(alignments: DataFrame, key: str = "qname", pos: str = "pos", length: str = "length") -> DataFrame:
    """Alignments of the keys none of whose neighbours (by position) overlap or touch."""
    w = Window.partitionBy(key).orderBy(pos)
    clash = F.coalesce(F.col(pos) + F.col(length) >= F.lead(pos).over(w), F.lit(False))
    marked = alignments.withColumn("_clash", clash)
    return marked.withColumn("_any", F.max(F.col("_clash").cast("int")).over(Window.partitionBy(key))).filter("_any = 0").drop("_clash", "_any")
