"""Running statistics, quantiles, tests and correlations: all are groupings that merge partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..frames import cut_lineage, drop, running, with_totals

#: Autocorrelations of a chain that one pass takes; even.
LAGS = 64


def running_stats(cells: DataFrame, keys: list[str], size: int | Column | None = None, value: str = "value") -> DataFrame:
    """``nnz`` (values above zero), ``tot``, ``mu``, ``sig`` (population) for each of `keys`.

    `size` counts the cells of a group, absent zeros too; without it, the finite values present. Values that
    aren't finite are skipped.
    """
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    x = F.when(finite, v)
    got = cells.groupBy(*keys).agg(
        F.coalesce(F.sum((x > 0).cast("long")), F.lit(0)).alias("nnz"), F.coalesce(F.sum(x), F.lit(0.0)).alias("tot"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias("_s2"), F.count(x).alias("_n")
    )
    n = F.col("_n") if size is None else (F.lit(size) if isinstance(size, int) else size)
    mu = F.when(n > 0, F.col("tot") / n).otherwise(0.0)
    got = got.withColumn("mu", mu)
    return got.withColumn("sig", F.when(n > 0, F.sqrt(F.greatest(F.col("_s2") / n - F.col("mu") * F.col("mu"), F.lit(0.0)))).otherwise(0.0)).drop("_s2", "_n")


def _at_places(df: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """A column for each of `places`, numbers from 0 in a group's ordered values by ``_n``, with what stands there; and ``_n``.

    Distinct values are counted first, so that equal ones, however many, are one row of a range.
    """
    levels = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(F.count("*").alias("_c"))
    placed = running(levels, keys, [F.col("_x")], {"_to": F.col("_c")}, total="_n")
    here = lambda at: (at < F.col("_to")) & (at >= F.col("_to") - F.col("_c"))
    hit = F.lit(False)
    for at in places.values():
        hit = hit | here(at)
    # a few rows a group are left
    return placed.filter(hit).groupBy(*keys).agg(F.first("_n").alias("_n"), *(F.max(F.when(here(at), F.col("_x"))).alias(c) for c, at in places.items()))


def floor_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """The value at place ⌊q(n − 1)⌋ of each group, for each of `probs` (column ``q``), without interpolation."""
    got = _at_places(df, keys, value, {f"_q{k}": F.floor(q * (F.col("_n") - 1)) for k, q in enumerate(probs)})
    every = F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"_q{k}").alias("quantile")) for k, q in enumerate(probs)))
    return got.select(*keys, F.inline(every))


def interpolated_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """A column for each of `probs`: the value at place q(n − 1), between its two neighbours in proportion."""
    places = {}
    for c, q in probs.items():
        places |= {f"_low_{c}": F.floor(q * (F.col("_n") - 1)), f"_high_{c}": F.ceil(q * (F.col("_n") - 1))}
    got = _at_places(df, keys, value, places)
    part = lambda q: q * (F.col("_n") - 1) - F.floor(q * (F.col("_n") - 1))
    return got.select(*keys, *((F.col(f"_low_{c}") + part(q) * (F.col(f"_high_{c}") - F.col(f"_low_{c}"))).alias(c) for c, q in probs.items()))


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The mean of the middle two."""
    return interpolated_quantiles(df, keys, value, {"median": 0.5})


def benjamini_hochberg(tests: DataFrame, p: str = "p", ident: str = "id") -> DataFrame:
    """`tests` with ``q``: the least of m·p/rank over the p-values from its own up, at most 1.

    Rows without a p-value, or with one that isn't a number, have no ``q`` and don't count in m. Equal p-values
    have one ``q``: ranks are sums over the distinct p-values, in ranges, so that no task sorts everything.
    """
    known = tests.filter(F.col(p).isNotNull() & ~F.isnan(p))
    levels = known.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_c"))
    ranked = running(levels, [], [F.col("_p")], {"_rank": F.col("_c")}, total="_m")
    least = running(ranked, [], [F.col("_p").desc()], {"_q": F.col("_p") * F.col("_m") / F.col("_rank")}, least=True)
    least = least.select("_p", F.greatest(F.least(F.col("_q"), F.lit(1.0)), F.lit(0.0)).alias("q"))
    return tests.join(least, F.col(p) == F.col("_p"), "left").drop("_p")


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Ranks from 1; ties share the mean of their ranks. Ranks are sums over a group's distinct values, in ranges."""
    levels = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranked = running(levels, keys, [F.col(value)], {"_to": F.col("_c")})
    named = ranked.select(*(F.col(c).alias(f"_k_{c}") for c in (*keys, value)), (F.col("_to") - (F.col("_c") - 1) / 2).alias(out))
    same = F.lit(True)
    for c in (*keys, value):
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(named, same).drop(*(f"_k_{c}" for c in (*keys, value)))


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    ranked = average_ranks(average_ranks(df, keys, a, "_ra"), keys, b, "_rb")
    return ranked.groupBy(*keys).agg(F.corr("_ra", "_rb").alias("rho"))


def pearson_log1p(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pearson's correlation of log(1 + x); values below zero count as zero."""
    x, y = (F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in (a, b))
    return df.groupBy(*keys).agg(F.corr(x, y).alias("r"))


def rate_to_counts(df: DataFrame, keys: list[str], observed: str, rate: str, out: str = "predicted") -> DataFrame:
    """Rates scaled to the group's observed total."""
    scaled = F.col(rate) * F.col("_seen") / F.col("_rates")
    return with_totals(df, keys, _seen=F.sum(observed), _rates=F.sum(rate)).withColumn(out, scaled).drop("_seen", "_rates")


def log_rate_to_counts(df: DataFrame, keys: list[str], observed: str, log_rate: str, out: str = "predicted") -> DataFrame:
    """`rate_to_counts` of exp(log rate), less the group's largest so that nothing overflows."""
    shifted = with_totals(df, keys, _top=F.max(log_rate)).withColumn("_rate", F.exp(F.col(log_rate) - F.col("_top")))
    return rate_to_counts(shifted, keys, observed, "_rate", out).drop("_top", "_rate")


def bootstrap_mean(df: DataFrame, keys: list[str], ident: str, value: str, draws: int = 200, seed: int = 1, alpha: float = 0.05) -> DataFrame:
    """``mean``, ``se``, ``low``, ``high`` of each group's mean by a Poisson bootstrap with draws keyed by row.

    Each row enters each draw as often as a Poisson variate of mean one says, found from a hash of its id, so
    results don't depend on partitions and no group is gathered.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(ident), F.col("_draw")), F.lit(1 << 40)) + 0.5) / (1 << 40)
    cumulated, term, times = 0.0, 2.718281828459045**-1, F.lit(0)
    for k in range(8):
        cumulated += term
        times = times + (u > cumulated).cast("int")
        term /= k + 1
    drawn = df.select(*keys, ident, value, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw")).withColumn("_t", times)
    means = drawn.groupBy(*keys, "_draw").agg((F.sum(F.col(value) * F.col("_t")) / F.sum("_t")).alias("_m"))
    spread = means.groupBy(*keys).agg(F.stddev_samp("_m").alias("se"), F.array_sort(F.collect_list("_m")).alias("_ms"))
    at = lambda q: F.element_at("_ms", F.least(F.floor(F.lit(q) * F.size("_ms")) + 1, F.size("_ms")).cast("int"))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean")).join(spread, keys).select(*keys, "mean", "se", at(alpha / 2).alias("low"), at(1 - alpha / 2).alias("high"))


def sign_flip_p(df: DataFrame, keys: list[str], ident: str, value: str, draws: int = 200, seed: int = 1) -> DataFrame:
    """Two-sided p of a zero mean: signs are flipped by a hash of id and draw; (1 + #as large) / (1 + draws)."""
    sign = F.when(F.pmod(F.xxhash64(F.lit(seed), F.col(ident), F.col("_draw")), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    drawn = df.select(*keys, value, ident, F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("_draw"))
    sums = drawn.withColumn("_s", F.when(F.col("_draw") == 0, 1.0).otherwise(sign)).groupBy(*keys, "_draw").agg(F.abs(F.sum(F.col(value) * F.col("_s"))).alias("_t"))
    own = F.max(F.when(F.col("_draw") == 0, F.col("_t")))
    return sums.withColumn("_own", own.over(W.partitionBy(*keys))).groupBy(*keys).agg(((1 + F.sum(((F.col("_draw") > 0) & (F.col("_t") >= F.col("_own"))).cast("int"))) / (1 + F.lit(draws))).alias("p"))


# -- chains ------------------------------------------------------------------------------------------


def chain_summary(draws: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``mean``, ``variance`` (n − 1) and the interpolated quantiles 5 %, 50 %, 95 % of each chain."""
    moments = draws.groupBy(*keys).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))
    return moments.join(interpolated_quantiles(draws, keys, value, {"q05": 0.05, "q50": 0.5, "q95": 0.95}), keys)


def _rhat(segments: DataFrame, keys: list[str], length: Column) -> DataFrame:
    """``_inside`` from the segments' ``_m`` and ``_v``: the root of the pooled variance over the mean variance within."""
    both = segments.groupBy(*keys).agg(F.avg("_v").alias("_w"), F.var_samp("_m").alias("_b"))
    inside = F.sqrt(((length - 1) / length * F.col("_w") + F.col("_b")) / F.col("_w"))
    return both.withColumn("_inside", F.when(F.col("_w") == 0, F.when(F.col("_b") == 0, 1.0).otherwise(float("inf"))).otherwise(inside))


def split_rhat(draws: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """R̂ of each chain over four equal segments (two below 40 draws, 1 below 8); the rest of the draws is left out."""
    placed = running(draws.select(*keys, *order, value), keys, [F.col(c) for c in order], {"_k": F.lit(1)})
    placed = with_totals(placed, keys, _n=F.count("*")).withColumn("_k", F.col("_k") - 1)
    parts = F.when(F.col("_n") >= 40, 4).when(F.col("_n") >= 8, 2).otherwise(1)
    length = F.floor(F.col("_n") / parts)
    placed = placed.withColumn("_len", length).withColumn("_parts", parts).withColumn("_seg", F.floor(F.col("_k") / length)).filter("_seg < _parts")
    segments = placed.groupBy(*keys, "_seg", "_len", "_parts").agg(F.avg(value).alias("_m"), F.var_samp(value).alias("_v"))
    return _rhat(segments, [*keys, "_len", "_parts"], F.col("_len")).select(*keys, F.when(F.col("_parts") == 1, 1.0).otherwise(F.col("_inside")).alias("rhat"))


def split_rhat_chains(draws: DataFrame, keys: list[str], chain: str, order: list[str], value: str = "value") -> DataFrame:
    """R̂ over the halves of several chains, each cut to the shortest one's length; 1 if that is below 4."""
    placed = running(draws.select(*keys, chain, *order, value), [*keys, chain], [F.col(c) for c in order], {"_k": F.lit(1)})
    lengths = draws.groupBy(*keys, chain).agg(F.count("*").alias("_n"))
    shortest = lengths.groupBy(*keys).agg(F.floor(F.min("_n") / 2).alias("_half"))
    halves = (placed.join(shortest, keys) if keys else placed.join(F.broadcast(shortest))).withColumn("_seg", F.floor((F.col("_k") - 1) / F.col("_half"))).filter("_seg < 2 or _half = 0")
    segments = halves.groupBy(*keys, chain, "_seg", "_half").agg(F.avg(value).alias("_m"), F.var_samp(value).alias("_v"))
    return _rhat(segments, [*keys, "_half"], F.col("_half")).select(*keys, F.when(F.col("_half") < 2, 1.0).otherwise(F.col("_inside")).alias("rhat"))


def _lagged_sums(rows: DataFrame, keys: list[str], first: int) -> DataFrame:
    """``_cs``: the sums of products of values that lie `first`, `first` + 1, … positions apart, LAGS of them, by `keys`.

    Positions are cut into blocks; a block meets the two blocks in which its partners lie, so a group holds three
    blocks' values, however long the chain.
    """
    block, back = F.floor(F.col("_k") / LAGS), first // LAGS
    copies = F.array(F.struct(block.alias("b"), F.lit(True).alias("own")), *(F.struct((block - back - i).alias("b"), F.lit(False).alias("own")) for i in (0, 1)))
    placed = rows.withColumn("_c", F.explode(copies)).filter("_c.b >= 0")
    value = F.struct("_k", "_x")
    sides = [F.transform(F.array_sort(F.collect_list(F.when(own, value))), lambda s: s["_x"]).alias(name) for name, own in (("_own", F.col("_c.own")), ("_far", ~F.col("_c.own")))]
    met = placed.groupBy(*keys, F.col("_c.b").alias("_b")).agg(*sides).filter((F.size("_own") > 0) & (F.size("_far") > 0))
    own = F.transform("_own", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    sums = F.transform(F.sequence(F.lit(0), F.lit(LAGS - 1)), lambda lag: F.aggregate(own, F.lit(0.0), lambda a, s: a + s["x"] * F.coalesce(F.get("_far", s["i"] + lag), F.lit(0.0))))
    by_lag = met.select(*keys, F.posexplode(sums).alias("_lag", "_s")).groupBy(*keys, "_lag").agg(F.sum("_s").alias("_s"))
    return by_lag.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_lag", "_s"))), lambda s: s["_s"]).alias("_cs"))


def ess(draws: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """``n``, ``ess``: effective sample size by the initial monotone positive sequence of paired autocorrelations.

    Lags are taken LAGS at a time, and a chain goes on until its first pair that is not positive. Null draws are left
    out; a chain of fewer than 4 draws, or of equal ones, counts in full.
    """
    named = {c: f"_id_{i}" for i, c in enumerate(keys)}
    placed = running(draws.filter(F.col(value).isNotNull()).select(*keys, *order, F.col(value).cast("double").alias("_v")), keys, [F.col(c) for c in order], {"_k": F.lit(1)})
    placed = with_totals(placed, keys, _n=F.count("*"), _m=F.avg("_v"))
    rows = cut_lineage(placed.select(*keys, F.col("_n").alias("n"), (F.col("_k") - 1).alias("_k"), (F.col("_v") - F.col("_m")).alias("_x")))
    found = rows.groupBy(*keys, "n").agg(F.sum(F.col("_x") * F.col("_x")).alias("_all"))
    start = F.struct(F.lit(-1.0).alias("tau"), F.lit(float("inf")).alias("last"), ((F.col("n") >= 4) & (F.col("_all") > 0)).alias("on"))
    state, first = cut_lineage(found.withColumn("_t", start)), 0
    same = F.lit(True)
    for c, as_ in named.items():
        same = same & F.col(c).eqNullSafe(F.col(as_))
    while not (going := state.filter("_t.on")).isEmpty():
        ids = going.select(*(F.col(c).alias(as_) for c, as_ in named.items()))
        live = rows.join(ids, same, "left_semi") if keys else rows
        sums = _lagged_sums(live, keys, first).withColumnsRenamed(named)

        def pair(t: Column, m: Column) -> Column:
            rho = (F.get("_cs", 2 * m) + F.get("_cs", 2 * m + 1)) / F.col("_all")
            on = t["on"] & (rho > 0) & (2 * m + 1 + first < F.col("n"))
            last = F.when(on, F.least(t["last"], rho)).otherwise(t["last"])
            return F.struct(F.when(on, t["tau"] + 2 * last).otherwise(t["tau"]).alias("tau"), last.alias("last"), F.coalesce(on, F.lit(False)).alias("on"))

        steps = F.aggregate(F.sequence(F.lit(0), F.lit(LAGS // 2 - 1)), F.col("_t"), pair)
        joined = state.join(sums, same, "left") if keys else state.join(F.broadcast(sums))
        later = cut_lineage(joined.select(*keys, "n", "_all", F.when(F.col("_t.on"), steps).otherwise(F.col("_t")).alias("_t")))
        drop(state)
        state, first = later, first + LAGS
    drop(rows)
    size = F.when((F.col("n") >= 4) & (F.col("_all") > 0), F.least(F.col("n").cast("double"), F.col("n") / F.greatest("_t.tau", F.lit(1e-12))))
    return state.select(*keys, "n", F.coalesce(size, F.col("n").cast("double")).alias("ess"))


def mcse_proportion(hits: Column, n: Column) -> Column:
    """Standard error of a proportion, smoothed by half a hit and half a miss."""
    p = (hits + 0.5) / (n + 1)
    return F.sqrt(p * (1 - p) / n)
