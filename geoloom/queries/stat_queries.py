"""Queries of ordered analytics, sampling and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import AREAS, FRAMES, GROUPS, OBSERVED, areas, frames, groups, observed
from ..operators import ordered, stats
from ..registry import query

col, r6 = F.col, lambda c: F.round(c, 6)


@query("cumulative_area", f"SELECT id, round(area, 4) AS area, round(sum(area) OVER (ORDER BY area, id ROWS UNBOUNDED PRECEDING), 2) AS total FROM ({AREAS})")
def cumulative_area(t):
    return ordered.running_total(areas(t), "area", ["id"], col("area"), "total").select("id", F.round("area", 4).alias("area"), F.round("total", 2).alias("total"))


@query("sorted_array", f"SELECT dist, string_agg(CAST(CAST(floor(area) AS BIGINT) AS VARCHAR), ',' ORDER BY floor(area)) AS sorted, count(*) AS n FROM ({AREAS}) GROUP BY dist")
def sorted_array(t):
    a = areas(t).groupBy("dist").agg(F.array_sort(F.collect_list(F.floor("area").cast("bigint"))).alias("a"))
    return a.select("dist", F.array_join(F.col("a").cast("array<string>"), ",").alias("sorted"), F.size("a").cast("bigint").alias("n"))


_IN = "SELECT CAST(l_quantity AS BIGINT) AS v FROM lineitem WHERE l_returnflag = 'A'"
_REF = "SELECT CAST(p_size AS BIGINT) AS f FROM part"


def matching(t):
    return t.lineitem.filter("l_returnflag = 'A'").selectExpr("1 band", "cast(l_quantity as bigint) v"), t.part.selectExpr("1 band", "cast(p_size as bigint) f")


@query("histogram", f"SELECT v, count(*) AS n FROM ({_IN}) WHERE v <> 0 GROUP BY v")
def histogram(t):
    return matching(t)[0].filter("v <> 0").groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def _cdf(source, v):
    return f"SELECT {v}, n, sum(n) OVER (ORDER BY {v}) / sum(n) OVER () AS cdf FROM (SELECT {v}, count(*) AS n FROM ({source}) GROUP BY {v})"


@query("cdf", f"SELECT v, n, round(cdf, 6) AS cdf FROM ({_cdf(_IN, 'v')})")
def cdf(t):
    return ordered.cdf(matching(t)[0], ["band"], "v").select("v", "n", r6("cdf").alias("cdf"))


@query("histogram_match", f"""WITH i AS ({_cdf(_IN, "v")}), r AS ({_cdf(_REF, "f")}),
b AS (SELECT i.v, i.n, i.cdf, max(CASE WHEN r.cdf <= i.cdf THEN r.cdf END) AS x0, min(CASE WHEN r.cdf >= i.cdf THEN r.cdf END) AS x1 FROM i, r GROUP BY ALL)
SELECT v, b.n, round(CASE WHEN x0 IS NULL THEN f1.f WHEN x1 IS NULL OR x0 = x1 THEN f0.f ELSE f0.f + (b.cdf - x0) * (f1.f - f0.f) / (x1 - x0) END, 5) AS matched
FROM b LEFT JOIN r f0 ON f0.cdf = x0 LEFT JOIN r f1 ON f1.cdf = x1""")  # fmt: skip
def histogram_match(t):
    return ordered.histogram_match(*matching(t), ["band"], "v", "f").select("v", "n", F.round("matched", 5).alias("matched"))


@query("average_rank", f"SELECT id, rank() OVER (ORDER BY dist) + (count(*) OVER (PARTITION BY dist) - 1) / 2 AS rk FROM ({AREAS})")
def average_rank(t):
    return ordered.average_ranks(areas(t), "dist", "rk").select("id", "rk")


def _rank(v):
    return f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2"


@query("spearman", f"SELECT round(corr(rx, ry), 6) AS rho FROM (SELECT {_rank('obs')} AS rx, {_rank('pred')} AS ry FROM ({OBSERVED}))")
def spearman(t):
    return ordered.spearman(observed(t), "obs", "pred").select(r6("rho").alias("rho"))


_P = "(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))))"


@query("mann_whitney", f"""WITH r AS (SELECT first, {_rank("v")} AS rk FROM ({GROUPS})), s AS (SELECT count(CASE WHEN first THEN 1 END) AS n1, count(CASE WHEN NOT first THEN 1 END) AS n2, sum(CASE WHEN first THEN rk END) AS r1 FROM r),
u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u FROM s), z AS (SELECT *, (u - n1 * n2 / 2) / sqrt(n1::DOUBLE * n2 * (n1 + n2 + 1) / 12) AS z FROM u), t AS (SELECT *, 1 / (1 + 0.3275911 * (abs(z) / sqrt(2.0))) AS t FROM z)
SELECT n1, n2, round(u, 4) AS u, round(z, 6) AS z, round({_P} * exp(-(z * z) / 2), 6) AS p, {_P} * exp(-(z * z) / 2) < 0.05 AS significant FROM t""")  # fmt: skip
def mann_whitney(t):
    m = ordered.mann_whitney(groups(t), "v", "first")
    return m.select("n1", "n2", F.round("u", 4).alias("u"), r6("z").alias("z"), r6("p").alias("p"), (col("p") < 0.05).alias("significant"))


@query("asof_nearest", """WITH p AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'),
v AS (SELECT event_id AS view_id, user_id, CAST(ts AS DATE) AS d, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
m AS (SELECT p.event_id, v.view_id, abs(p.t - v.t) AS dt, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - v.t), v.view_id) AS rn FROM p LEFT JOIN v ON p.user_id = v.user_id AND p.d = v.d)
SELECT event_id, view_id, dt FROM m WHERE rn = 1""")  # fmt: skip
def asof_nearest(t):
    e = t.events.select("event_id", "user_id", "event_type", F.to_date("ts").alias("d"), F.expr("unix_micros(cast(ts as timestamp))").alias("t"))
    views = e.filter("event_type = 'view'").withColumnRenamed("event_id", "view_id")
    return ordered.nearest_in_time(e.filter("event_type = 'purchase'"), views, ["user_id", "d"], "t", "event_id", "view_id")


def _draw(seed=0):
    return f"((id + {seed}) * 2654435761) % 4294967296"


@query("stratified_sample", f"SELECT id, zone FROM (SELECT id, zone, row_number() OVER (PARTITION BY zone ORDER BY {_draw()}, id) AS rn FROM ({FRAMES})) WHERE rn <= 2")
def stratified_sample(t):
    return ordered.stratified(frames(t), "zone", "id", 2).select("id", "zone")


@query("random_year", f"SELECT id, CAST([2019, 2021, 2023][CAST({_draw(5)} % 3 AS BIGINT) + 1] AS BIGINT) AS year FROM ({FRAMES})")
def random_year(t):
    years = F.array(*[F.lit(y).cast("bigint") for y in (2019, 2021, 2023)])
    return frames(t).select("id", F.element_at(years, (ordered.draw(col("id"), 5) % 3 + 1).cast("int")).alias("year"))


@query("split_dataset", f"""WITH n AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.2) AS BIGINT) AS test FROM ({FRAMES})), r AS (SELECT id, row_number() OVER (ORDER BY {_draw()}, id) AS rn FROM ({FRAMES}))
SELECT id, CASE WHEN rn <= test THEN 'test' WHEN rn <= test + CAST(floor((n - test) * 0.2) AS BIGINT) THEN 'val' ELSE 'train' END AS part FROM r, n""")  # fmt: skip
def split_dataset(t):
    return ordered.split(frames(t), "id").select("id", "part")


@query("kfold", f"SELECT id, ntile(10) OVER (ORDER BY {_draw(1117)}, id) AS fold FROM ({FRAMES})")
def kfold(t):
    return ordered.kfold(frames(t), "id").select("id", "fold")


@query("area_weights", f"SELECT id, round(area / sum(area) OVER (), 9) AS weight FROM ({FRAMES})")
def area_weights(t):
    total = F.broadcast(frames(t).agg(F.sum("area").alias("all")))  # one row
    return frames(t).crossJoin(total).select("id", F.round(col("area") / col("all"), 9).alias("weight"))


@query("weighted_sample", f"""WITH f AS (SELECT id, CAST(area AS DOUBLE) AS area FROM ({FRAMES}) WHERE area > 0), u AS (SELECT id, area, sum(area) OVER (ORDER BY area, id ROWS UNBOUNDED PRECEDING) AS upto FROM f),
d AS (SELECT id AS draw_no, {_draw(7)} / 4294967296.0 * (SELECT sum(area) FROM f) AS u FROM (SELECT unnest(range(1000)) AS id)) SELECT draw_no, u.id FROM d JOIN u ON d.u >= u.upto - u.area AND d.u < u.upto""")  # fmt: skip
def weighted_sample(t):
    return ordered.weighted_sample(frames(t), "id", "area", 1000)


@query("random_patches", f"SELECT id, CAST(floor({_draw(1)} / 4294967296.0 * greatest(w - 128, 1)) AS BIGINT) AS x, CAST(floor({_draw(2)} / 4294967296.0 * greatest(h - 128, 1)) AS BIGINT) AS y FROM (SELECT id, 100 + area * 7 AS w, 80 + area * 5 AS h FROM ({FRAMES}))")
def random_patches(t):
    f = frames(t).select("id", (100 + col("area") * 7).alias("w"), (80 + col("area") * 5).alias("h"))
    place = lambda size, seed: F.floor(ordered.share_drawn(col("id"), seed) * F.greatest(size - 128, F.lit(1))).cast("bigint")
    return f.select("id", place(col("w"), 1).alias("x"), place(col("h"), 2).alias("y"))


@query("r2_score", f"""SELECT round(1 - sum((obs - pred) * (obs - pred)) / (var_pop(obs) * count(*)), 6) AS r2, round(sum(pred - obs) * 100 / sum(obs), 6) AS bias_pct, round(sqrt(avg((pred - obs) * (pred - obs))), 6) AS rmse, count(*) AS n FROM ({OBSERVED})""")
def r2_score(t):
    return _rounded(stats.r2_score(observed(t), "obs", "pred", []))


def _rounded(df):
    return df.select(*[r6(c).alias(c) if k == "double" else c for c, k in df.dtypes])


@query("bias_pct", f"SELECT grp, round(sum(pred - obs) * 100 / sum(obs), 6) AS bias_pct FROM ({OBSERVED}) GROUP BY grp")
def bias_pct(t):
    return _rounded(stats.r2_score(observed(t), "obs", "pred", ["grp"]).select("grp", "bias_pct"))


@query("ols_by_group", f"SELECT grp, round(regr_slope(pred, obs), 6) AS slope, round(regr_intercept(pred, obs), 6) AS intercept, round(regr_r2(pred, obs), 6) AS r2, count(*) AS n FROM ({OBSERVED}) GROUP BY grp")
def ols_by_group(t):
    return _rounded(stats.ols(observed(t), "obs", "pred", ["grp"]))


@query("rmse_by_group", f"SELECT grp, round(sqrt(avg((pred - obs) * (pred - obs))), 6) AS rmse, count(*) AS n FROM ({OBSERVED}) GROUP BY grp")
def rmse_by_group(t):
    return _rounded(stats.r2_score(observed(t), "obs", "pred", ["grp"]).select("grp", "rmse", "n"))


@query("linregress", f"SELECT round(regr_slope(area, dist), 6) AS slope, round(regr_intercept(area, dist), 4) AS intercept, round(corr(area, dist), 6) AS r FROM ({AREAS})")
def linregress(t):
    return areas(t).agg(r6(F.regr_slope("area", "dist")).alias("slope"), F.round(F.regr_intercept("area", "dist"), 4).alias("intercept"), r6(F.corr("area", "dist")).alias("r"))


@query("group_priors", f"SELECT first, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, count(*) AS n FROM ({GROUPS}) GROUP BY first")
def group_priors(t):
    return _rounded(groups(t).groupBy("first").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count(F.lit(1)).alias("n")))


EDGES = [1000.0, 5000.0, 50000.0, 150000.0, 300000.0, 500000.0]
_BIN = "CASE " + " ".join(f"WHEN area {'>=' if i == 0 else '>'} {a} AND area <= {b} THEN {i}" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))) + " END"


@query("bin_cut", f"SELECT id, CAST({_BIN} AS BIGINT) AS bin, dist // 10 * 10 AS dist_bin FROM ({AREAS})")
def bin_cut(t):
    return areas(t).select("id", stats.right_closed(col("area"), EDGES, True).alias("bin"), stats.floor_bin(col("dist"), 10).alias("dist_bin"))


@query("bin_pivot", f"SELECT dist // 10 * 10 AS dist_bin, " + ", ".join(f"round(coalesce(sum(CASE WHEN ({_BIN}) = {i} THEN area END), 0) / 1000000, 6) AS bin_{i}" for i in range(5)) + f" FROM ({AREAS}) WHERE ({_BIN}) IS NOT NULL GROUP BY 1")
def bin_pivot(t):
    b = areas(t).select(stats.floor_bin(col("dist"), 10).alias("dist_bin"), stats.right_closed(col("area"), EDGES, True).alias("bin"), "area").filter("bin IS NOT NULL")
    p = b.groupBy("dist_bin").pivot("bin", list(range(5))).agg(F.sum("area")).na.fill(0.0)
    return p.select("dist_bin", *[r6(col(str(i)) / 1e6).alias(f"bin_{i}") for i in range(5)]).orderBy("dist_bin")


@query("bin_share", f"""WITH a AS (SELECT CAST(ceil(dist / 10) AS BIGINT) - 1 AS b, area FROM ({AREAS}) WHERE dist > 0 AND dist <= 310), s AS (SELECT g.b, coalesce(sum(a.area), 0) AS area FROM (SELECT unnest(range(31)) AS b) g LEFT JOIN a ON a.b = g.b GROUP BY g.b)
SELECT b * 10 + 5.0 AS mid, round(area / 1000000, 6) AS area, round(area / sum(area) OVER (), 6) AS share FROM s""")  # fmt: skip
def bin_share(t):
    b = areas(t).filter("dist > 0").withColumn("b", (F.ceil(col("dist") / 10) - 1).cast("bigint")).groupBy("b").agg(F.sum("area").alias("area"))
    every = t.spark.range(31).select(col("id").alias("b")).join(b, "b", "left").na.fill(0.0, ["area"])  # a row for each bin
    s = stats.share_of_total(every, "area", [], "share")
    return s.select((col("b") * 10 + 5.0).alias("mid"), r6(col("area") / 1e6).alias("area"), r6("share").alias("share"))


@query("sum_by_key", f"SELECT dist % 3 AS region, round(sum(area), 2) AS area, round(max(area), 4) AS most FROM ({AREAS}) WHERE dist % 3 IN (0, 1) GROUP BY 1")
def sum_by_key(t):
    return areas(t).withColumn("region", col("dist") % 3).filter(col("region").isin(0, 1)).groupBy("region").agg(F.round(F.sum("area"), 2).alias("area"), F.round(F.max("area"), 4).alias("most"))


@query("share_of_total", f"SELECT dist, round(sum(area) / sum(sum(area)) OVER (PARTITION BY dist % 5), 6) AS share FROM ({AREAS}) GROUP BY dist")
def share_of_total(t):
    s = areas(t).groupBy("dist").agg(F.sum("area").alias("area")).withColumn("k", col("dist") % 5)
    return stats.share_of_total(s, "area", ["k"], "share").select("dist", r6("share").alias("share"))


@query("bf_bands", f"SELECT id, CASE WHEN bf > 10 THEN 'strong' WHEN bf > 3 THEN 'moderate' WHEN bf > 1 THEN 'weak' ELSE 'none' END AS label FROM (SELECT id, dist / 20.0 AS bf FROM ({AREAS}))")
def bf_bands(t):
    return areas(t).select("id", stats.bf_label(col("dist") / 20.0).alias("label"))


@query("posterior_difference")
def posterior_difference(t):
    return stats.group_difference_posterior(groups(t), "first", "v")


@query("posterior_summary")
def posterior_summary(t):
    return stats.hdi(stats.group_difference_posterior(groups(t), "first", "v"), "difference", ["chain"])


@query("savage_dickey")
def savage_dickey(t):
    d = stats.density_at_zero(stats.group_difference_posterior(groups(t), "first", "v"), "difference", 1000.0)
    return d.withColumn("label", stats.bf_label(col("bf10")))


@query("correlation_posterior", f"""WITH s AS (SELECT count(*) AS n, corr(obs, pred) AS r FROM ({OBSERVED})), g AS (SELECT i * 2 / 200 - 1 AS rho, n, r FROM (SELECT unnest(range(1, 200)) AS i), s),
l AS (SELECT rho, -n / 2 * ln(1 - rho * rho) - n * (1 - rho * r) / (1 - rho * rho) AS l FROM g), w AS (SELECT rho, exp(l - max(l) OVER ()) AS w FROM l) SELECT round(rho, 6) AS rho, round(w / sum(w) OVER (), 6) AS weight FROM w""")  # fmt: skip
def correlation_posterior(t):
    return _rounded(stats.correlation_posterior(observed(t), "obs", "pred"))


@query("waic", f"""WITH l AS (SELECT a.id AS o, d.k, -0.5 * pow((a.v - 4500 - d.k * 20) / 3000, 2) - ln(3000 * sqrt(2 * pi())) AS l FROM ({GROUPS}) a, (SELECT unnest(range(-5, 6)) AS k) d), b AS (SELECT o, ln(avg(exp(l))) AS lppd, var_samp(l) AS p FROM l GROUP BY o)
SELECT round(sum(lppd - p), 4) AS elpd, round(-2 * sum(lppd - p), 4) AS waic, round(sum(p), 6) AS p_waic FROM b""")  # fmt: skip
def waic(t):
    d = groups(t).select("id", "v", F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("k"))
    l = d.select("id", (-0.5 * ((col("v") - 4500 - col("k") * 20) / 3000) ** 2 - F.log(3000 * F.sqrt(2 * F.pi()))).alias("l"))  # noqa: E741
    w = stats.waic(l, "id", "l")
    return w.select(F.round("elpd", 4).alias("elpd"), F.round("waic", 4).alias("waic"), r6("p_waic").alias("p_waic"))


#: Two-sided p of t with three degrees of freedom, in closed form.
_P3 = "1 - 2 / pi() * (atan(t / sqrt(3.0)) + t / sqrt(3.0) / (1 + t * t / 3))"


@query("slope_p_value", f"""WITH g AS (SELECT id // 5 AS grp, regr_slope(area, dist) AS slope, corr(dist, area) AS r, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS id, area, dist FROM ({AREAS})) GROUP BY 1)
SELECT grp, round(slope, 4) AS slope, round({_P3}, 6) AS p FROM (SELECT *, abs(r) * sqrt(3.0 / (1 - r * r)) AS t FROM g WHERE n = 5 AND abs(r) < 1)""")  # fmt: skip
def slope_p_value(t):
    rows = ordered.row_numbers(areas(t), "id", [], "rn").withColumn("grp", F.floor((col("rn") - 1) / 5))
    return stats.regression(rows, "dist", "area", ["grp"]).filter("n = 5 AND abs(r) < 1").select("grp", F.round("slope", 4).alias("slope"), r6("p").alias("p"))


@query("shortest_interval", f"""WITH o AS (SELECT dist % 7 AS grp, list(area ORDER BY area) AS d FROM ({AREAS}) GROUP BY 1), k AS (SELECT grp, d, CAST(least(floor(len(d) * 0.5), len(d) - 1) AS BIGINT) AS k FROM o),
w AS (SELECT grp, d[i] AS low, d[i + k] AS high FROM (SELECT grp, d, k, unnest(range(1, len(d) - k + 1)) AS i FROM k))
SELECT grp, round(arg_min(low, (high - low, low)), 4) AS low, round(arg_min(high, (high - low, low)), 4) AS high FROM w GROUP BY grp""")  # fmt: skip
def shortest_interval(t):
    rows = areas(t).withColumn("grp", col("dist") % 7)
    return stats.hdi(rows, "area", ["grp"], 0.5).select("grp", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("correlation_bayes_factor", f"""WITH d AS (SELECT count(*) AS n, corr(dist, area) AS r FROM ({AREAS})),
l AS (SELECT -n / 2 * ln(1 - rho * rho) - n * (1 - rho * r) / (1 - rho * rho) + n AS l, n, r FROM (SELECT i * 2 / 200 - 1 AS rho FROM (SELECT unnest(range(1, 200)) AS i)), d)
SELECT any_value(n) AS n, round(any_value(r), 6) AS r, round(ln(sum(exp(l)) / 200), 5) AS ln_bf10 FROM l""")  # fmt: skip
def correlation_bayes_factor(t):
    return stats.correlation_bayes_factor(areas(t), "dist", "area").select("n", r6("r").alias("r"), F.round("ln_bf10", 5).alias("ln_bf10"))


def _likelihood(t, mean, step):
    d = groups(t).select("id", "v", F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("k"))
    return d.select("id", (-0.5 * ((col("v") - mean - col("k") * step) / 3000) ** 2 - F.log(3000 * F.sqrt(2 * F.pi()))).alias("l"))


def _loo(mean, step):
    return f"""(SELECT sum(elpd) AS elpd, sum(lppd - elpd) AS p_loo, count(CASE WHEN k > 0.7 THEN 1 END) AS n_bad, max(k) AS k_max FROM
 (SELECT -ln(avg(exp(-l))) AS elpd, ln(avg(exp(l))) AS lppd, list_avg(list_sort(list(-l), 'DESC')[1:3]) - list_sort(list(-l), 'DESC')[4] AS k FROM
 (SELECT a.id, -0.5 * pow((a.v - {mean} - d.k * {step}) / 3000, 2) - ln(3000 * sqrt(2 * pi())) AS l FROM ({GROUPS}) a, (SELECT unnest(range(-5, 6)) AS k) d) GROUP BY id))"""


@query("loo_bayes_factor", f"""SELECT round(a.elpd, 4) AS elpd_null, round(b.elpd, 4) AS elpd_alt, round(b.elpd - a.elpd, 4) AS ln_bf10, round(b.p_loo, 6) AS p_loo, b.n_bad, round(b.k_max, 5) AS k_max
FROM {_loo(4000, 20)} a, {_loo(4500, 400)} b""")  # fmt: skip
def loo_bayes_factor(t):
    null = stats.loo(_likelihood(t, 4000, 20), "id", "l").select(col("elpd").alias("null"))
    alt = stats.loo(_likelihood(t, 4500, 400), "id", "l")
    both = alt.crossJoin(F.broadcast(null))  # one row each
    return both.select(F.round("null", 4).alias("elpd_null"), F.round("elpd", 4).alias("elpd_alt"), F.round(col("elpd") - col("null"), 4).alias("ln_bf10"), r6("p_loo").alias("p_loo"), "n_bad", F.round("k_max", 5).alias("k_max"))
