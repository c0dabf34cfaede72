"""Running totals, ranks, nearest neighbours in time, distribution matching, sampling and splits.

Whole-table orders are never one window: rows are dealt to ranges of the order, as many as the session's shuffles have
partitions (adaptive execution joins small ones), each range is a window partition of its own, and the ranges' totals, a
row each, are added as offsets. Ties are part of the order, so a value that very many rows have is dealt out as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_folder


def ranged(df: DataFrame, by: str, ties: list[str]) -> DataFrame:
    """Adds range_no: rows in ascending order of ``by`` and ``ties`` (nulls first) are in ranges of ascending number. The
    rows are kept in the shared folder, so that a range has the same rows whenever it is read."""
    shared_folder(df.sparkSession)
    return df.repartitionByRange(by, *ties).withColumn("range_no", F.spark_partition_id()).checkpoint()


def running_total(df: DataFrame, by: str, ties: list[str], value: Column, out: str) -> DataFrame:
    """Adds the total of ``value`` over all rows up to each, ordered by ``by`` and then ``ties``."""
    cut = ranged(df.withColumn("rt_value", value), by, ties)
    sums = cut.groupBy("range_no").agg(F.sum("rt_value").alias("range_sum"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    offsets = sums.select("range_no", F.coalesce(F.sum("range_sum").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("range_no").orderBy(by, *ties).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(F.broadcast(offsets), "range_no")  # a row for each partition of a shuffle
    return joined.withColumn(out, F.col("offset") + F.sum("rt_value").over(inside)).drop("range_no", "offset", "rt_value")


def carried(df: DataFrame, by: str, ties: list[str], value: str, out: str) -> DataFrame:
    """Adds the last value that isn't null in all rows up to each, ordered by ``by`` and then ``ties``."""
    cut = ranged(df, by, ties)
    there = F.when(F.col(value).isNotNull(), F.struct(by, *ties))
    lasts = cut.groupBy("range_no").agg(F.max_by(value, there).alias("range_last"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    offsets = lasts.select("range_no", F.last("range_last", True).over(before).alias("before"))
    inside = Window.partitionBy("range_no").orderBy(by, *ties).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(F.broadcast(offsets), "range_no")  # a row for each partition of a shuffle
    return joined.withColumn(out, F.coalesce(F.last(value, True).over(inside), "before")).drop("range_no", "before")


def row_numbers(df: DataFrame, by: str, ties: list[str], out: str = "rn") -> DataFrame:
    """A running number over the whole table, ordered by ``by`` and ``ties``."""
    return running_total(df, by, ties, F.lit(1).cast("bigint"), out)


def ranks_of(df: DataFrame, value: str, out: str) -> DataFrame:
    """(ar_value, out): the rank of each distinct value, ties sharing their mean. Values are counted first, so that
    ties cost nothing."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("ar_n"))
    upto = running_total(counts, value, [], F.col("ar_n"), "ar_upto")
    return upto.select(F.col(value).alias("ar_value"), (F.col("ar_upto") - (F.col("ar_n") - 1) / 2).alias(out))


def average_ranks(df: DataFrame, value: str, out: str, ranks: DataFrame | None = None) -> DataFrame:
    """Adds ranks in which ties share their mean."""
    ranks = ranks_of(df, value, out) if ranks is None else ranks
    return df.join(ranks, F.col(value).eqNullSafe(F.col("ar_value"))).drop("ar_value")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row with rho, the correlation of average ranks."""
    rx, ry = ranks_of(df, x, "rx"), ranks_of(df, y, "ry")
    pairs = df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    both = average_ranks(average_ranks(pairs, x, "rx", rx), y, "ry", ry)
    n, a, b = F.col("n").cast("double"), F.col("rx"), F.col("ry")
    s = both.agg(F.sum(n).alias("n"), F.sum(n * a * b).alias("ab"), F.sum(n * a * a).alias("aa"), F.sum(n * b * b).alias("bb"))
    total = F.col("n") * ((F.col("n") + 1) / 2) ** 2  # the mean of ranks is (n + 1) / 2
    return s.select(((F.col("ab") - total) / F.sqrt((F.col("aa") - total) * (F.col("bb") - total))).alias("rho"))


def normal_two_sided(z: Column) -> Column:
    """Two-sided p of a normal z: a rational approximation of erfc, right to about 1e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def mann_whitney(df: DataFrame, value: str, first: str) -> DataFrame:
    """One row with n1, n2, u of the rows where ``first`` is true, z (no tie correction) and p."""
    r = average_ranks(df.select(value, first), value, "rk")
    s = r.agg(F.count_if(F.col(first)).alias("n1"), F.count_if(~F.col(first)).alias("n2"), F.sum(F.when(F.col(first), F.col("rk"))).alias("r1"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    z = (F.col("u") - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return s.select("n1", "n2", u.alias("u")).withColumn("z", z).withColumn("p", normal_two_sided(F.col("z")))


def nearest_in_time(targets: DataFrame, candidates: DataFrame, keys: list[str], time: str, target_id: str, candidate_id: str) -> DataFrame:
    """(target_id, candidate_id, dt) of each target: the candidate with the same keys that is nearest in time (a long);
    of equally near ones the smallest id. Null where there is none.

    The two are laid together and swept once in order of time, forwards and backwards, so a group of n targets and m
    candidates costs n + m, not n * m.
    """
    both = targets.select(*keys, F.col(time).alias("t"), F.col(target_id).alias("target"), F.lit(None).cast(candidates.schema[candidate_id].dataType).alias("candidate")).unionByName(
        candidates.select(*keys, F.col(time).alias("t"), F.lit(None).cast(targets.schema[target_id].dataType).alias("target"), F.col(candidate_id).alias("candidate"))
    )
    w = Window.partitionBy(*keys).orderBy("t")
    mine = F.col("candidate").isNotNull()
    earlier = F.max(F.when(mine, F.struct(F.col("t"), (-F.col("candidate")).alias("c")))).over(w.rangeBetween(Window.unboundedPreceding, 0))
    later = F.min(F.when(mine, F.struct(F.col("t"), F.col("candidate").alias("c")))).over(w.rangeBetween(0, Window.unboundedFollowing))
    swept = both.select("*", earlier.alias("a"), later.alias("b")).filter("target IS NOT NULL")
    a = F.when(F.col("a").isNotNull(), F.struct((F.col("t") - F.col("a.t")).alias("dt"), (-F.col("a.c")).alias("c")))
    b = F.when(F.col("b").isNotNull(), F.struct((F.col("b.t") - F.col("t")).alias("dt"), F.col("b.c").alias("c")))
    best = F.least(a, b)
    return swept.select(F.col("target").alias(target_id), best["c"].alias(candidate_id), best["dt"].alias("dt"))


def cdf(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, cdf) of each distinct value of a band: as many rows as a band has values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    upto = F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("cdf", upto / F.sum("n").over(w))


def interpolated(x: DataFrame, points: DataFrame, by: list[str], at: str, xp: str, fp: str, out: str) -> DataFrame:
    """Piecewise linear interpolation of points (xp, fp) at x[at], clamped at both ends: one sweep over each group."""
    both = x.withColumn("i_x", F.col(at)).withColumn("i_p", F.lit(None).cast("struct<x:double,f:double>")).unionByName(
        points.select(*by, F.col(xp).alias("i_x"), F.struct(F.col(xp).cast("double").alias("x"), F.col(fp).cast("double").alias("f")).alias("i_p")), allowMissingColumns=True
    )
    w = Window.partitionBy(*by).orderBy("i_x")
    lo = F.last("i_p", True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    hi = F.first("i_p", True).over(w.rangeBetween(0, Window.unboundedFollowing))
    s = both.select("*", lo.alias("lo"), hi.alias("hi")).filter("i_p IS NULL")
    lo, hi, v = F.col("lo"), F.col("hi"), F.col("i_x")
    line = F.when(lo.isNull(), hi["f"]).when(hi.isNull() | (lo["x"] == hi["x"]), lo["f"]).otherwise(lo["f"] + (v - lo["x"]) * (hi["f"] - lo["f"]) / (hi["x"] - lo["x"]))
    return s.withColumn(out, line).drop("i_x", "i_p", "lo", "hi")


def histogram_match(pixels: DataFrame, reference: DataFrame, by: list[str], value: str, ref_value: str, nodata: float | None = None) -> DataFrame:
    """(by, value, n, matched) of each distinct value: the reference value at the same place of the distribution.
    Nodata isn't matched. The join back to pixels is on (by, value). A band without reference has null."""
    clean = lambda d, v: d if nodata is None else d.filter(F.col(v) != nodata)
    mine = cdf(clean(pixels, value), by, value)
    theirs = cdf(clean(reference, ref_value), by, ref_value)
    return interpolated(mine, theirs, by, "cdf", "cdf", ref_value, "matched").select(*by, value, "n", "matched")


# ---- sampling and splits, by a number drawn from the id ----


def draw(id_: Column, seed: int = 0) -> Column:
    """A reproducible number in [0, 2^32) of an integer id."""
    return F.pmod((id_ + seed) * 2654435761, F.lit(4294967296))


def stratified(df: DataFrame, stratum: str, id_: str, n: int) -> DataFrame:
    """n rows of each stratum (all of smaller ones). Each task keeps n before the shuffle."""
    w = Window.partitionBy(stratum).orderBy(draw(F.col(id_)), id_)
    return df.withColumn("s_rn", F.row_number().over(w)).filter(F.col("s_rn") <= n).drop("s_rn")


def split(df: DataFrame, id_: str, test_ratio: float = 0.2, val_ratio: float = 0.2) -> DataFrame:
    """Adds part: test, then val as a ratio of what is left, then train."""
    numbered = row_numbers(df.withColumn("s_draw", draw(F.col(id_))), "s_draw", [id_], "s_rn")
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("s_n")))  # one row
    test = F.floor(F.col("s_n") * test_ratio)
    val = F.floor((F.col("s_n") - test) * val_ratio)
    part = F.when(F.col("s_rn") <= test, "test").when(F.col("s_rn") <= test + val, "val").otherwise("train")
    return numbered.crossJoin(total).withColumn("part", part).drop("s_draw", "s_rn", "s_n")


def kfold(df: DataFrame, id_: str, k: int = 10, seed: int = 1117) -> DataFrame:
    """Adds fold, 1 to k, whose sizes differ by one at most."""
    numbered = row_numbers(df.withColumn("s_draw", draw(F.col(id_), seed)), "s_draw", [id_], "s_rn")
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("s_n")))  # one row
    n, rn = F.col("s_n"), F.col("s_rn") - 1
    q, r = F.floor(n / k), n % k
    fold = F.when(rn < r * (q + 1), F.floor(rn / (q + 1))).otherwise(r + F.floor((rn - r * (q + 1)) / F.greatest(q, F.lit(1)))) + 1
    return numbered.crossJoin(total).withColumn("fold", fold.cast("bigint")).drop("s_draw", "s_rn", "s_n")


def share_drawn(id_: Column, seed: int) -> Column:
    """A reproducible number in [0, 1) of an integer id."""
    return draw(id_, seed) / F.lit(4294967296.0)


def weighted_sample(df: DataFrame, id_: str, weight: str, n: int, seed: int = 7) -> DataFrame:
    """(draw_no, id) of n draws with replacement, in proportion to the weights. Rows lie one after the other, each as
    long as its weight; n numbers are laid on the same line, and each takes the row that begins last before it: one
    sweep over rows and draws together. Draws depend on their number and the seed only."""
    upto = running_total(df.filter(F.col(weight) > 0).select(id_, weight), weight, [id_], F.col(weight), "w_upto")
    total = F.broadcast(df.filter(F.col(weight) > 0).agg(F.sum(weight).cast("double").alias("w_all")))  # one row
    kind = dict(df.dtypes)[id_]
    begins = upto.select((F.col("w_upto") - F.col(weight)).cast("double").alias("at"), F.lit(-1).cast("bigint").alias("draw_no"), F.col(id_).alias("taken"))
    drawn = df.sparkSession.range(n).crossJoin(total).select((share_drawn(F.col("id"), seed) * F.col("w_all")).alias("at"), F.col("id").alias("draw_no"), F.lit(None).cast(kind).alias("taken"))
    # of rows and draws at one place the row comes first, as its number is -1
    return carried(begins.unionByName(drawn), "at", ["draw_no"], "taken", "w_id").filter("draw_no >= 0").select("draw_no", F.col("w_id").alias(id_))
