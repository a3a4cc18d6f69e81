"""Log-likelihoods of counts, as expressions over a long table of observed and expected values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import with_totals
from ..functions.normalise import dot, doubles
from ..functions.special import approx_lgamma


def poisson(x: Column, rate: Column) -> Column:
    """x ln λ − λ."""
    return x * F.log(rate) - rate


def negative_binomial(x: Column, mean: Column, log_dispersion: Column) -> Column:
    """One element's log-likelihood; the mean is held in [1e-6, 1e6], ln φ in [−10, 10]."""
    mu = F.greatest(F.least(mean, F.lit(1e6)), F.lit(1e-6))
    phi = F.exp(F.greatest(F.least(log_dispersion, F.lit(10.0)), F.lit(-10.0)))
    return approx_lgamma(x + phi) - approx_lgamma(phi) - approx_lgamma(x + 1) + phi * F.log(phi / (phi + mu)) + x * F.log(mu / (phi + mu))


def zero_inflated(x: Column, log_p: Column, zero_logit: Column) -> Column:
    """x ln p for counts above 0; a zero is either inflated or the topic's own, whichever by their sum."""
    inflated = F.log(1 / (1 + F.exp(-zero_logit)))
    own = F.log(1 / (1 + F.exp(zero_logit)))
    zero = F.greatest(inflated, own - F.exp(log_p)) + F.log1p(F.exp(-F.abs(inflated - own + F.exp(log_p))))
    return F.when(x > 0, own + x * log_p).otherwise(zero)


def topic(x: Column, p: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) * F.log(p + 1e-8)


def gaussian(x: Column, fitted: Column) -> Column:
    return -0.5 * (x - fitted) * (x - fitted)


def gaussian_kl(mean: Column, log_variance: Column) -> Column:
    """One element of −½ Σ (1 + ln σ² − μ² − σ²)."""
    return -0.5 * (1 + log_variance - mean * mean - F.exp(log_variance))


def summed(cells: DataFrame, keys: list[str], element: Column, out: str = "llik") -> DataFrame:
    """The sum of a likelihood's elements for each of `keys`."""
    return cells.groupBy(*keys).agg(F.sum(element).alias(out))


def dirichlet_multinomial(cells: DataFrame, keys: list[str], x: str, concentration: str) -> DataFrame:
    """``llik`` of each group's counts under its concentrations."""
    a, n = F.sum(concentration), F.sum(x)
    parts = F.sum(approx_lgamma(F.col(x) + F.col(concentration)) - approx_lgamma(F.col(concentration)))
    return cells.groupBy(*keys).agg((approx_lgamma(a) - approx_lgamma(n + a) + parts).alias("llik"))


def multinomial_profiled(cells: DataFrame, keys: list[str], x: str, score: str) -> DataFrame:
    """``nll`` N·logsumexp(s) − Σ x s."""
    topped = with_totals(cells, keys, _top=F.max(score))
    got = topped.groupBy(*keys).agg(F.sum(x).alias("_n"), F.max("_top").alias("_top"), F.sum(F.col(x) * F.col(score)).alias("_xs"), F.sum(F.exp(F.col(score) - F.col("_top"))).alias("_s"))
    return got.select(*keys, (F.col("_n") * (F.col("_top") + F.log("_s")) - F.col("_xs")).alias("nll"))


def joint(*parts: DataFrame, keys: list[str]) -> DataFrame:
    """``llik`` over several modalities: the sum of their ``llik`` for each of `keys`."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*keys).agg(F.sum("llik").alias("llik"))


def pair_hinge(pairs: DataFrame, distance: str, weight: str, margin: float) -> DataFrame:
    """``loss`` Σ w max(0, 1 − d/m)² / Σ w, one row."""
    short = F.greatest(1 - F.col(distance) / margin, F.lit(0.0))
    return pairs.agg((F.sum(F.col(weight) * short * short) / F.sum(weight)).alias("loss"))


def topic_rates(theta: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``row``, ``feature``, ``rate`` Σ_t θ_rt β_tf, from ``row``, ``topic``, ``theta`` and ``topic``, ``feature``, ``beta``."""
    return theta.join(dictionary, "topic").groupBy("row", "feature").agg(F.sum(F.col("theta") * F.col("beta")).alias("rate"))


def hidden_cells(rows: DataFrame, features: int, rate: float, epoch: int = 0, seed: int = 42) -> DataFrame:
    """``row``, ``feature``: the same number of hidden features in each row, chosen by a hash of (seed, epoch, row)."""
    many = min(max(round(rate * features), 1), max(features - 1, 1))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda f: F.struct(F.xxhash64(F.lit(seed), F.lit(epoch), F.col("row"), f).alias("h"), f.alias("f")))
    return rows.select("row", F.explode(F.slice(F.array_sort(drawn), 1, many)).alias("t")).select("row", F.col("t.f").alias("feature"))


# -- features and modules outside a dictionary ---------------------------------------------------------


def topic_scores(features: DataFrame, topics: np.ndarray, ident: str = "id", vector: str = "features") -> DataFrame:
    """``feature``, ``topic``, ``score``: products of the features' vectors with those of the topics, a small matrix with a row for each."""
    scores = F.array(*(dot(doubles(F.col(vector)), F.lit(np.asarray(row, float).tolist())) for row in topics))
    return features.select(F.col(ident).alias("feature"), F.posexplode(scores).alias("topic", "score"))


def normalisers(scores: DataFrame) -> DataFrame:
    """``topic``, ``top``, ``sum``: the largest score and Σ exp(score − top) over the features, which `merged` adds up."""
    topped = with_totals(scores.select("topic", "score"), ["topic"], top=F.max("score"))
    return topped.groupBy("topic").agg(F.max("top").alias("top"), F.sum(F.exp(F.col("score") - F.col("top"))).alias("sum"))


def merged(*parts: DataFrame) -> DataFrame:
    """The normalisers of all features of several tables that have none in common; a row for each topic and part meets."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    met = every.groupBy("topic").agg(F.max("top").alias("top"), F.collect_list(F.struct("top", "sum")).alias("parts"))
    return met.select("topic", "top", F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["sum"] * F.exp(p["top"] - F.col("top"))).alias("sum"))


def shares_of(scores: DataFrame, found: DataFrame) -> DataFrame:
    """``topic``, ``feature``, ``beta``: the features' shares of each topic, normalised over what `found` (`normalisers`) has seen."""
    return scores.join(found, "topic").select("topic", "feature", (F.exp(F.col("score") - F.col("top")) / F.col("sum")).alias("beta"))


def module_dictionary(dictionary: DataFrame, members: DataFrame) -> DataFrame:
    """``topic``, ``module``, ``beta``: shares of modules, each the sum over its features (``feature``, ``module``)."""
    return dictionary.join(members.select("feature", "module"), "feature").groupBy("topic", "module").agg(F.sum("beta").alias("beta"))


def unseen_parts(theta: DataFrame, modules: DataFrame, totals: DataFrame, visible: DataFrame, members: DataFrame, least: float = 1e-6) -> DataFrame:
    """``row``, ``module``, ``rate``, ``unseen``, ``share``: what a row's context has not seen of each module.

    ``unseen`` is the module's total (`totals`: ``row``, ``module``, ``x``; absent ones are 0) less the counts of its visible features
    (`visible`: ``row``, ``feature``, ``x``), ``share`` what these leave of it (`members`: ``feature``, ``module``, ``share``, a
    feature's part of its module), ``rate`` Σ θβ. Modules whose share is not above `least` are left out.
    """
    rates = topic_rates(theta, modules.withColumnRenamed("module", "feature")).withColumnRenamed("feature", "module")
    seen = visible.join(members, "feature").groupBy("row", "module").agg(F.sum("x").alias("seen"), F.sum("share").alias("seen_share"))
    met = rates.join(totals.groupBy("row", "module").agg(F.sum("x").alias("x")), ["row", "module"], "left").join(seen, ["row", "module"], "left")
    left = F.coalesce("x", F.lit(0.0)) - F.coalesce("seen", F.lit(0.0))
    out = met.select("row", "module", "rate", F.greatest(left, F.lit(0.0)).alias("unseen"), (1 - F.coalesce("seen_share", F.lit(0.0))).alias("share"))
    return out.filter(F.col("share") > least)


def score_unseen_nb(parts: DataFrame, sizes: DataFrame, log_dispersion: Column, offsets: DataFrame | None = None) -> DataFrame:
    """``row``, ``llik``, ``scored``: unseen counts under the negative binomial with mean size · rate · share, and the number of modules.

    `parts` is from `unseen_parts`, `sizes` has ``row`` and ``size``, `offsets` a factor ``offset`` for each ``row``, ``module``.
    """
    met = parts.join(sizes, "row")
    mean = F.col("rate") * F.col("share") * F.col("size")
    if offsets is not None:
        met = met.join(offsets, ["row", "module"], "left")
        mean = mean * F.coalesce("offset", F.lit(1.0))
    return met.groupBy("row").agg(F.sum(negative_binomial(F.col("unseen"), mean, log_dispersion)).alias("llik"), F.count("*").alias("scored"))


def score_unseen_multinomial(parts: DataFrame) -> DataFrame:
    """``row``, ``llik`` Σ unseen · ln(rate · share), and ``scored``."""
    element = F.col("unseen") * F.log(F.col("rate") * F.col("share") + 1e-20)
    return parts.groupBy("row").agg(F.sum(element).alias("llik"), F.count("*").alias("scored"))
