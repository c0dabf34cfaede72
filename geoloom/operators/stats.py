"""Regression, binning and comparison statistics as aggregates, and the seeded samplers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def r2_score(df: DataFrame, obs: str, pred: str, by: list[str]) -> DataFrame:
    """1 - SSres / SStot of the raw prediction, bias in percent, rmse and n; in one pass."""
    e = F.col(pred) - F.col(obs)
    return df.groupBy(*by).agg(
        (1 - F.sum(e * e) / (F.var_pop(obs) * F.count(obs))).alias("r2"),
        F.try_divide(F.sum(e) * 100, F.sum(obs)).alias("bias_pct"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.count(F.lit(1)).alias("n"),
    )


def ols(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Slope, intercept, fitted r2 and n of y on x; of each group."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def right_closed(v: Column, edges: list[float], include_lowest: bool = False) -> Column:
    """Number of the bin (edge, next edge] from 0 on; null outside."""
    out = F.when(F.lit(False), F.lit(0))
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        low = v >= lo if include_lowest and i == 0 else v > lo
        out = out.when(low & (v <= hi), i)
    return out.cast("bigint")


def floor_bin(v: Column, size: int) -> Column:
    return (F.floor(v / size) * size).cast("bigint")


def share_of_total(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    return df.withColumn(out, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*by))))


def bf_label(bf: Column) -> Column:
    """Reading of a Bayes factor."""
    return F.when(bf > 10, "strong").when(bf > 3, "moderate").when(bf > 1, "weak").otherwise("none")


def group_difference_posterior(df: DataFrame, group: str, value: str, draws: int = 500, chains: int = 4, tune: int = 300, seed: int = 1) -> DataFrame:
    """(chain, draw, mu1, mu2, difference) of a Metropolis sampler for two groups with normal values and normal priors
    at their means. Data come in as five numbers for each group, whatever their size; a task is a chain."""
    stats = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    both = stats.agg(*[f(F.when(F.col(group) == g, F.col(c))).alias(f"{c}{k}") for k, g in ((1, True), (2, False)) for c, f in (("n", F.max), ("m", F.max), ("s", F.max))])
    tasks = both.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))

    def run(pdf):
        import numpy as np
        import pandas as pd

        r = pdf.iloc[0]
        rng, out = np.random.default_rng(seed * 1000 + int(r["chain"])), {}
        for k in (1, 2):
            n, m, s = float(r[f"n{k}"]), float(r[f"m{k}"]), max(float(r[f"s{k}"]), 1e-9)
            mu, kept, step = m, [], 2.4 * s / max(n, 1) ** 0.5
            log = lambda v: -0.5 * n * ((v - m) / s) ** 2 - 0.5 * ((v - m) / s) ** 2  # noqa: B023, E731
            for i in range(tune + draws):
                new = mu + step * rng.normal()
                if np.log(rng.random()) < log(new) - log(mu):
                    mu = new
                if i >= tune:
                    kept.append(mu)
            out[f"mu{k}"] = kept
        d = pd.DataFrame(out)
        return pd.DataFrame({"chain": int(r["chain"]), "draw": range(draws), "mu1": d["mu1"], "mu2": d["mu2"], "difference": d["mu1"] - d["mu2"]})

    return tasks.groupBy("chain").applyInPandas(run, "chain int, draw int, mu1 double, mu2 double, difference double")


def density_at_zero(posterior: DataFrame, value: str, prior_sd: float | None = None) -> DataFrame:
    """Gaussian kernel density of the draws at 0, and with a normal prior the ratios both ways: bf01 = posterior /
    prior (for no difference) and bf10, its inverse."""
    s = posterior.agg(F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    h = F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    k = posterior.crossJoin(F.broadcast(s)).select(F.exp(-0.5 * (F.col(value) / h) ** 2).alias("k"), h.alias("h"), "s")  # one row
    d = k.agg((F.avg("k") / (F.first("h") * (2 * 3.141592653589793) ** 0.5)).alias("density"), F.first("s").alias("s"))
    prior = F.lit(1 / (prior_sd * (2 * 3.141592653589793) ** 0.5)) if prior_sd else 1 / (F.col("s") * 10 * (2 * 3.141592653589793) ** 0.5)
    return d.select("density", F.try_divide(F.col("density"), prior).alias("bf01"), F.try_divide(prior, F.col("density")).alias("bf10"))


def correlation_posterior(df: DataFrame, x: str, y: str, steps: int = 199) -> DataFrame:
    """(rho, weight) on a grid over (-1, 1) for standardised normal pairs with a flat prior: the data come in as n and
    their correlation. weight adds up to 1."""
    s = df.agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))
    rho = df.sparkSession.range(1, steps + 1).select((F.col("id") * 2 / (steps + 1) - 1).alias("rho"))
    n, r, p = F.col("n"), F.col("r"), F.col("rho")
    log = -n / 2 * F.log(1 - p * p) - n * (1 - p * r) / (1 - p * p)
    g = rho.crossJoin(F.broadcast(s)).select("rho", "n", "r", log.alias("l"))  # one row
    top = F.broadcast(g.agg(F.max("l").alias("top")))
    w = g.crossJoin(top).select("rho", F.exp(F.col("l") - F.col("top")).alias("w"))
    return share_of_total(w, "w", [], "weight").select("rho", "weight")


def waic(log_likelihood: DataFrame, observation: str, value: str) -> DataFrame:
    """elpd and WAIC from (observation, draw, log-likelihood) rows."""
    by = log_likelihood.groupBy(observation).agg((F.log(F.avg(F.exp(value)))).alias("lppd"), F.var_samp(value).alias("p"))
    return by.agg(F.sum(F.col("lppd") - F.col("p")).alias("elpd"), (-2 * F.sum(F.col("lppd") - F.col("p"))).alias("waic"), F.sum("p").alias("p_waic"))


def loo(log_likelihood: DataFrame, observation: str, value: str) -> DataFrame:
    """elpd, p and the number of observations with a tail index over 0.7, by leaving one out with importance sampling,
    from (observation, draw, log-likelihood) rows; an observation has a bounded number of draws.

    The ratios are 1 / likelihood, as they come: they aren't smoothed. The tail index is Hill's, over the largest
    min(S / 5, 3 sqrt(S)) ratios of S draws, rounded up."""
    size = F.size("d")
    tail = F.ceil(F.least(size / 5, 3 * F.sqrt(size.cast("double")))).cast("int")
    by = log_likelihood.groupBy(observation).agg(F.sort_array(F.collect_list(-F.col(value)), False).alias("d"), F.max(value).alias("top")).withColumns({"m": tail, "s": size})
    # sums of exponentials about the largest, so that none overflows
    total = lambda sign, about: F.aggregate("d", F.lit(0.0), lambda a, x: a + F.exp(sign * x - about))
    elpd = -(F.col("d")[0] + F.log(total(1, F.col("d")[0]) / F.col("s")))
    lppd = F.col("top") + F.log(total(-1, F.col("top")) / F.col("s"))
    hill = F.when(F.col("m") < F.col("s"), F.aggregate(F.slice("d", F.lit(1), F.col("m")), F.lit(0.0), lambda a, x: a + x) / F.col("m") - F.get("d", F.col("m")))
    each = by.select(elpd.alias("elpd"), (lppd - elpd).alias("p"), hill.alias("k"))
    return each.agg(F.sum("elpd").alias("elpd"), F.sum("p").alias("p_loo"), F.count_if(F.col("k") > 0.7).alias("n_bad"), F.max("k").alias("k_max"))


def correlation_bayes_factor(df: DataFrame, x: str, y: str, steps: int = 199) -> DataFrame:
    """Natural logarithm of the Bayes factor of a correlation, uniform on (-1, 1), against none, for standardised normal pairs: the
    likelihood averaged over the grid over that at zero."""
    s = df.agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))
    rho = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: i * 2 / (steps + 1) - 1)
    n, r = F.col("n"), F.col("r")
    over_null = lambda p: -n / 2 * F.log(1 - p * p) - n * (1 - p * r) / (1 - p * p) + n
    g = s.select("n", "r", F.transform(rho, over_null).alias("l")).withColumn("top", F.array_max("l"))
    mean = F.aggregate("l", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top"))) / (steps + 1)
    return g.select("n", "r", (F.col("top") + F.log(mean)).alias("ln_bf10"))


def hdi(df: DataFrame, value: str, by: list[str], mass: float = 0.94) -> DataFrame:
    """Mean and highest-density interval of a posterior by group: of all intervals between two draws that hold the mass
    the shortest, of equals the lowest. A posterior is a bounded number of draws, sorted as an array."""
    draws = F.array_sort(F.collect_list(value))
    rows = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"), draws.alias("d"))
    k = F.least(F.floor(F.size("d") * F.lit(mass)).cast("int"), F.size("d") - 1)
    every = F.transform(F.sequence(F.lit(0), F.size("d") - 1 - F.col("k")), lambda i: F.struct((F.get("d", i + F.col("k")) - F.get("d", i)).alias("width"), F.get("d", i).alias("low"), F.get("d", i + F.col("k")).alias("high")))
    best = rows.withColumn("k", k).withColumn("best", F.array_min(every))
    return best.select(*by, "mean", F.col("best.low").alias("low"), F.col("best.high").alias("high"))


def t_two_sided(t: Column, freedom: Column, terms: int = 400) -> Column:
    """Two-sided p of Student's t, for whole degrees of freedom: the finite series in cos(theta), theta = atan(|t| /
    sqrt(n)), of up to ``terms`` terms; with more degrees the normal distribution of t brought to its scale, which is then within 1e-5."""
    theta, n = F.atan(F.abs(t) / F.sqrt(freedom)), freedom.cast("int")
    c2 = F.cos(theta) ** 2
    odd = n % 2 == 1
    count = F.when(odd, ((n - 1) / 2).cast("int")).otherwise((n / 2).cast("int"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))

    def step(a, k):  # term k of 1 + 1/2 c^2 + 1*3/(2*4) c^4 ..., or of 1 + 2/3 c^2 + 2*4/(3*5) c^4 ...
        up = F.when(odd, (2 * k) / (2 * k + 1.0)).otherwise((2 * k - 1) / (2.0 * k))
        return F.struct((a["term"] * up * c2).alias("term"), (a["sum"] + a["term"]).alias("sum"))

    series = F.when(count > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), start, step, lambda a: a["sum"])).otherwise(0.0)
    inside = F.when(odd, (theta + F.sin(theta) * F.cos(theta) * series) * (2 / 3.141592653589793)).otherwise(F.sin(theta) * series)
    small = F.greatest(F.lit(0.0), 1 - inside)
    x = F.abs(t) * (1 - 1 / (4 * freedom)) / F.sqrt(1 + t * t / (2 * freedom)) / F.sqrt(F.lit(2.0))
    u = 1 / (1 + 0.3275911 * x)
    large = u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429)))) * F.exp(-x * x)
    return F.when(freedom <= 0, F.lit(None)).when(freedom <= 2 * terms, small).otherwise(large)


def regression(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Slope, intercept, correlation, n, standard error of the slope and two-sided p of no slope, of each group; p is 0
    where all points lie on a line, and null for fewer than three points."""
    out = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy")
    )
    freedom = F.col("n") - 2
    error = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("r") ** 2) * F.col("vy") / F.col("vx") / F.when(freedom > 0, freedom))
    t = F.when(error > 0, F.col("slope") / error)
    p = F.when(freedom <= 0, F.lit(None)).when(error == 0, F.lit(0.0)).otherwise(t_two_sided(t, freedom))
    return out.select(*by, "slope", "intercept", "r", "n", error.alias("stderr"), p.alias("p"))
