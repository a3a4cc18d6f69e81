"""Every registered query over the test tables, with its SQL where SQL can express it.

A query and its SQL name their columns alike and round doubles to the same digits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import cut_lineage, shared_folder, with_totals
from ..functions import normalise as norm
from ..functions.special import approx_lgamma
from ..operators import archetypes, branching, cell_index, clusters, curves, edges, epochs, gamma, layout, likelihood, linear, lookups, neighbours, refined, sampling, stats, trajectory, traverse
from ..sources import ordered, sinks, tables
from ..streaming import stats as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """A double rounded for comparing; minus zero becomes zero."""
    column = F.col(c) if isinstance(c, str) else c
    return (F.round(column.cast("double"), digits) + F.lit(0.0)).alias(name or c)


# -- matrices: quantities by part and supplier --------------------------------------------------------


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum("l_quantity").alias("value"), F.sum("l_extendedprice").alias("price"))


CELLS = "cells AS (SELECT l_partkey AS row, l_suppkey AS col, sum(l_quantity) AS value, sum(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)"


@registered("""
WITH n AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1),
s AS (SELECT p_type AS name, l_returnflag AS "group", sum(CASE WHEN l_quantity > 0 THEN 1 ELSE 0 END)::BIGINT AS nnz, sum(l_quantity) AS tot, sum(l_quantity * l_quantity) AS s2
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT name, "group", nnz, round(tot, 6) AS tot, round(tot / n, 6) AS mu, round(sqrt(greatest(s2 / n - (tot / n) * (tot / n), 0)), 6) AS sig
FROM s JOIN n ON "group" = l_returnflag
""")
def grouped_running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics by part type and return flag; lines of other types count as zeros of the flag's lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", F.col("l_quantity").alias("value"))
    sizes = lines.groupBy("l_returnflag").agg(F.count("*").alias("size"))
    named = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    partial = named.join(sizes, "l_returnflag").select(F.col("p_type").alias("name"), F.col("l_returnflag").alias("group"), "size", "value")
    got = stats.running_stats(partial, ["name", "group", "size"], F.col("size"))
    return got.select("name", "group", "nnz", r("tot"), r("mu"), r("sig"))


@registered("""
SELECT l_suppkey, sum(CASE WHEN l_extendedprice > 0 THEN 1 ELSE 0 END)::BIGINT AS nnz, round(sum(l_extendedprice), 2) AS tot, round(avg(l_extendedprice), 4) AS mu,
       round(sqrt(greatest(sum(l_extendedprice * l_extendedprice) / count(*) - avg(l_extendedprice) * avg(l_extendedprice), 0)), 2) AS sig
FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1
""")
def column_running_stats_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    got = stats.running_stats(lines, ["l_suppkey"], value="l_extendedprice")
    return got.select("l_suppkey", "nnz", r("tot", 2), r("mu", 4), r("sig", 2))


def _normalised(name: str, change: Callable[[DataFrame], DataFrame], sql: str, exact: bool = False) -> None:
    """`exact`: quotients of whole numbers, which are the same on both sides, and can be ties at any number of digits."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return change(cells(spark, sf_dir)).select("row", "col", F.col("value") if exact else r("value"))

    query.__name__ = name
    registered(f"WITH {CELLS} SELECT row, col, {sql if exact else f'round({sql}, 6) + 0.0'} AS value FROM cells")(query)


_normalised("sum_to_one_columns", lambda c: norm.sum_to_one(c, "col"), "value / sum(value) OVER (PARTITION BY col)", exact=True)
_normalised("sum_to_one_rows", lambda c: norm.sum_to_one(c, "row"), "value / sum(value) OVER (PARTITION BY row)", exact=True)
_normalised("unit_length_columns", lambda c: norm.unit_length(c, "col"), "value / greatest(sqrt(sum(value * value) OVER (PARTITION BY col)), 1e-8)")
_normalised("centre_rows", lambda c: norm.centre(c, "row"), "value - avg(value) OVER (PARTITION BY row) + 0.0")
_normalised("scale_columns", lambda c: norm.scale(c, "col"), "CASE WHEN stddev_pop(value) OVER (PARTITION BY col) > 0 THEN (value - avg(value) OVER (PARTITION BY col)) / stddev_pop(value) OVER (PARTITION BY col) ELSE value - avg(value) OVER (PARTITION BY col) END + 0.0")
_normalised("scale_rows", lambda c: norm.scale(c, "row"), "CASE WHEN stddev_pop(value) OVER (PARTITION BY row) > 0 THEN (value - avg(value) OVER (PARTITION BY row)) / stddev_pop(value) OVER (PARTITION BY row) ELSE value - avg(value) OVER (PARTITION BY row) END + 0.0")
_TOP = "max(value) OVER (PARTITION BY col)"
ORACLES_LSE = f"WITH {CELLS}, t AS (SELECT row, col, value, {_TOP} AS top FROM cells) SELECT row, col, round("


def log_softmax_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm.log_softmax(cells(spark, sf_dir), "col").select("row", "col", r("value"))


def softmax_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm.softmax(cells(spark, sf_dir), "col").select("row", "col", r("value"))


registered(ORACLES_LSE + "value - top - ln(sum(exp(value - top)) OVER (PARTITION BY col)), 6) + 0.0 AS value FROM t")(log_softmax_columns)
registered(ORACLES_LSE + "exp(value - top - ln(sum(exp(value - top)) OVER (PARTITION BY col))), 6) AS value FROM t")(softmax_columns)
_normalised("log1p_cells", norm.log1p, "ln(1 + value)")


@registered(f"""
WITH {CELLS}
SELECT row, col, round(CASE WHEN price > 0 THEN value / (price * (sum(value) OVER (PARTITION BY col) / sum(price) OVER (PARTITION BY col))) ELSE value END, 6) AS ratio FROM cells
""")
def poisson_ratio_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm.poisson_ratio(cells(spark, sf_dir), "col", "value", "price").select("row", "col", r("ratio"))


@registered(f"""
WITH {CELLS}, a AS (SELECT row, col, 2 * sqrt(greatest(value, 0) + 0.375) AS x FROM cells),
b AS (SELECT row, col, x - avg(x) OVER (PARTITION BY row) AS x FROM a), c AS (SELECT row, col, x, 4 * stddev_pop(x) OVER (PARTITION BY col) + 1e-6 AS s FROM b)
SELECT row, col, round(s * tanh(x / s), 6) + 0.0 AS residual FROM c
""")
def anscombe_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm.anscombe_residual(cells(spark, sf_dir), "row", "col").select("row", "col", r("residual"))


TERMS = "terms AS (SELECT doc_id, term, count(*)::DOUBLE AS value FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS term FROM documents) GROUP BY 1, 2)"


@registered(f"""
WITH {TERMS}, d AS (SELECT term, count(*) AS df FROM terms GROUP BY 1)
SELECT doc_id, term, round(value * ln((SELECT count(*) FROM documents) / (df + 1)), 6) + 0.0 AS value FROM terms JOIN d USING (term)
""")
def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    terms = docs.select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").cast("double").alias("value"))
    return norm.tf_idf(terms, "term", "doc_id", docs.select("doc_id")).select("doc_id", "term", r("value"))


# -- quantiles, tests, correlations -------------------------------------------------------------------


@registered("""
WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
q AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS q)
SELECT event_type, q.q::DOUBLE AS q, value AS quantile FROM e, q WHERE k = floor(q.q::DOUBLE * (n - 1)) + 1
""")
def floor_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.floor_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.05, 0.25, 0.5, 0.75, 0.95])


@registered("SELECT o_orderpriority, round(median(o_totalprice), 6) AS median FROM orders GROUP BY 1")
def median_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.medians(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice").select("o_orderpriority", r("median"))


@registered("""
WITH t AS (SELECT o_orderkey AS id, ((o_orderkey * 7919) % 10007 + 1) / 10008.0::DOUBLE AS p FROM orders),
k AS (SELECT id, p, row_number() OVER (ORDER BY p, id) AS rank, count(*) OVER () AS m FROM t)
SELECT id, round(least(1.0, min(p * m / rank) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM k
""")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    tests = orders.select(F.col("o_orderkey").alias("id"), (((F.col("o_orderkey") * 7919) % 10007 + 1) / F.lit(10008.0)).alias("p"))
    return stats.benjamini_hochberg(tests).select("id", r("q", 9))


@registered("""
WITH a AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem),
k AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2 AS ry FROM a)
SELECT g AS l_returnflag, round(corr(rx, ry), 6) AS rho FROM k GROUP BY 1
""")
def spearman_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", r("rho"))


@registered("SELECT l_shipmonth, round(corr(ln(1 + greatest(l_quantity, 0)), ln(1 + greatest(l_extendedprice, 0))), 6) AS r FROM (SELECT *, month(l_shipdate) AS l_shipmonth FROM lineitem) GROUP BY 1")
def pearson_log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("l_shipmonth", F.month("l_shipdate").cast("long"))
    return stats.pearson_log1p(lines, ["l_shipmonth"], "l_quantity", "l_extendedprice").select("l_shipmonth", r("r"))


@registered(f"""
WITH {CELLS}, p AS (SELECT row, value, price * (sum(value) OVER (PARTITION BY row) / sum(price) OVER (PARTITION BY row)) AS predicted, count(*) OVER (PARTITION BY row) AS n FROM cells)
SELECT row, round(corr(ln(1 + value), ln(1 + predicted)), 5) AS r FROM p WHERE n >= 3 GROUP BY row HAVING stddev_pop(value) > 1e-9 AND stddev_pop(predicted) > 1e-9
""")
def agreement_from_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of a part's quantities with those that its prices predict, for parts with three suppliers or more."""
    scaled = stats.rate_to_counts(cells(spark, sf_dir), ["row"], "value", "price")
    several = scaled.groupBy("row").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("a"), F.stddev_pop("predicted").alias("b")).filter("n >= 3 and a > 1e-9 and b > 1e-9")
    return stats.pearson_log1p(scaled.join(several.select("row"), "row"), ["row"], "value", "predicted").select("row", r("r", 5))


@registered("""
WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
p AS (SELECT *, CASE WHEN n >= 40 THEN 4 WHEN n >= 8 THEN 2 ELSE 1 END AS parts FROM e), s AS (SELECT *, floor(n / parts)::BIGINT AS len FROM p),
g AS (SELECT user_id, parts, len, (k // len) AS seg, avg(value) AS m, var_samp(value) AS v FROM s WHERE k // len < parts GROUP BY 1, 2, 3, 4),
b AS (SELECT user_id, parts, len, avg(v) AS w, var_samp(m) AS b FROM g GROUP BY 1, 2, 3)
SELECT user_id, round(CASE WHEN parts = 1 THEN 1.0 ELSE sqrt(((len - 1) / len * w + b) / w) END, 6) AS rhat FROM b
""")
def split_rhat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.split_rhat(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", r("rhat"))


@registered("SELECT user_id, round(avg(value), 6) AS mean, round(var_samp(value), 7) AS variance, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95 FROM events GROUP BY 1")
def chain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.chain_summary(table(spark, sf_dir, "events"), ["user_id"]).select("user_id", r("variance", 7), *(r(c) for c in ("mean", "q05", "q50", "q95")))


@registered("""
WITH p AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
c AS (SELECT a.user_id, a.n, b.k - a.k AS lag, sum(a.x * b.x) AS c FROM p a JOIN p b ON a.user_id = b.user_id AND b.k >= a.k GROUP BY 1, 2, 3),
z AS (SELECT user_id, n, c AS z FROM c WHERE lag = 0),
g AS (SELECT user_id, n, lag // 2 AS m, sum(c) AS c FROM c WHERE lag // 2 * 2 + 1 < n GROUP BY 1, 2, 3),
q AS (SELECT user_id, min(g.c / z) OVER (PARTITION BY user_id ORDER BY m) AS low FROM g JOIN z USING (user_id)),
t AS (SELECT user_id, 2 * sum(CASE WHEN low > 0 THEN low ELSE 0 END) - 1 AS tau FROM q GROUP BY 1)
SELECT user_id, n, round(CASE WHEN n < 4 OR NOT z > 0 THEN n ELSE least(n, n / greatest(tau, 1e-12)) END, 6) AS ess FROM z LEFT JOIN t USING (user_id)
""")
def chain_ess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ess(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "n", r("ess"))


@registered("SELECT user_id, round(sqrt((h + 0.5) / (n + 1) * (1 - (h + 0.5) / (n + 1)) / n), 9) AS se FROM (SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS h FROM events GROUP BY 1)")
def mcse_of_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "click").cast("int")).alias("h"))
    return got.select("user_id", r(stats.mcse_proportion(F.col("h"), F.col("n")), 9, "se"))


@registered()
def bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bootstrap_mean(table(spark, sf_dir, "events"), ["event_type"], "event_id", "value").select("event_type", *(r(c) for c in ("mean", "se", "low", "high")))


@registered()
def sign_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether users' values lie around their event type's mean."""
    events = table(spark, sf_dir, "events")
    means = events.groupBy("event_type").agg(F.avg("value").alias("m"))
    return stats.sign_flip_p(events.join(means, "event_type").withColumn("d", F.col("value") - F.col("m")), ["user_id"], "event_id", "d").select("user_id", r("p"))


# -- top-k, triplets, lookups -------------------------------------------------------------------------


@registered(f"WITH {CELLS} SELECT row, col, rank, round(score, 6) AS score FROM (SELECT *, ln(1 + value) AS score, row_number() OVER (PARTITION BY row ORDER BY ln(1 + value) DESC, col) AS rank FROM cells) WHERE rank <= 3")
def topk_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.top_k(cells(spark, sf_dir), 3).select("row", "col", F.col("rank").cast("long").alias("rank"), r("score"))


@registered(f"""
WITH {CELLS}, t AS (SELECT row, col, value FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY value DESC, col) AS rank FROM cells) WHERE rank <= 4),
l AS (SELECT row, list(col ORDER BY col) AS i, list(value ORDER BY col) AS v FROM t GROUP BY 1)
SELECT row, array_to_string(list_concat(i, list_resize([]::BIGINT[], 4 - len(i), 0)), ',') AS indices, round(list_sum(v), 6) AS total FROM l
""")
def packed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lookups.packed(cells(spark, sf_dir), 4)
    return got.select("row", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"), r(norm.total(F.col("values")), 6, "total"))


@registered("SELECT vec_id AS row, generate_subscripts(embedding, 1) - 1 AS col, unnest(embedding)::DOUBLE AS value FROM embeddings")
def melt_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lookups.melt(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return got.select("row", F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))


@registered("SELECT vec_id AS row, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, len(embedding)::BIGINT AS width FROM embeddings")
def triplets_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    triplets = lookups.to_triplets(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("value", F.col("value").cast("double"))
    dense = lookups.from_triplets(triplets, 64)
    return dense.select("row", r(norm.total(F.col("features")), 4, "total"), F.size("features").cast("long").alias("width"))


ORACLES["triplets_round_trip"] = ORACLES["triplets_round_trip"].replace(", 6) AS total", ", 4) AS total")


@registered("""
WITH g AS (SELECT n_name AS key, r_name AS grp, n_nationkey AS no FROM nation JOIN region ON n_regionkey = r_regionkey),
k AS (SELECT DISTINCT key FROM (SELECT n_name AS key FROM nation UNION ALL SELECT n_name || '_x' FROM nation UNION ALL SELECT substr(n_name, 1, 4) FROM nation UNION ALL SELECT n_name || 'land' FROM nation UNION ALL SELECT c_mktsegment FROM customer)),
m AS (SELECT k.key, 0 AS r, g.no, g.grp FROM k JOIN g ON k.key = g.key UNION ALL SELECT k.key, 1, g.no, g.grp FROM k JOIN g ON split_part(k.key, '_', 1) = g.key
      UNION ALL SELECT k.key, 2, g.no, g.grp FROM k JOIN g ON starts_with(k.key, g.key) UNION ALL SELECT k.key, 3, g.no, g.grp FROM k JOIN g ON starts_with(g.key, k.key)),
b AS (SELECT key, min({'r': r, 'no': no, 'grp': grp}) AS best FROM m GROUP BY 1)
SELECT k.key, best.grp AS "group", coalesce(['exact', 'base', 'prefix', 'reverse'][best.r + 1], 'unmatched') AS rule FROM k LEFT JOIN b USING (key)
""")
def membership_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of nations, and market segments, to regions."""
    nation = table(spark, sf_dir, "nation")
    groups = nation.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("key"), F.col("r_name").alias("group"), F.col("n_nationkey").alias("no"))
    spelled = nation.select(F.explode(F.array("n_name", F.concat("n_name", F.lit("_x")), F.substring("n_name", 1, 4), F.concat("n_name", F.lit("land")))).alias("key"))
    keys = spelled.unionByName(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"))).distinct()
    return lookups.match_groups(keys, groups, "_")


@registered("""
WITH a AS (SELECT DISTINCT p_partkey AS id, unnest([p_name] || string_split(p_name, ' ')) AS alias FROM part)
SELECT alias, max(id) AS id, count(*) - 1 AS collisions FROM a WHERE alias <> '' GROUP BY 1
""")
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.aliases(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), " ")


@registered("SELECT p_partkey, 'chr' || p_size || ':' || p_partkey || '-' || (p_partkey + 10) AS locus, p_size || '_' || p_partkey || '_' || (p_partkey + 10) AS canonical FROM part")
def canonical_locus(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = table(spark, sf_dir, "part").select("p_partkey", F.format_string("chr%d:%d-%d", "p_size", "p_partkey", F.col("p_partkey") + 10).alias("locus"))
    return spelled.withColumn("canonical", lookups.canonical_locus(F.col("locus")))


@registered("SELECT p_partkey::VARCHAR AS p_partkey, coalesce(p_name, '') AS p_name, p_size::VARCHAR AS p_size FROM part")
def table_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_table(spark, f"{sf_dir}/part.parquet", ["p_partkey", "p_name", "p_size"])


@registered("SELECT c_custkey::VARCHAR AS row, round(c_custkey + c_nationkey + c_acctbal, 6) AS total FROM customer")
def matrix_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").withColumn("key", F.col("c_custkey").cast("string"))
    return tables.matrix_of(df, "key").select("row", r(norm.total(F.col("features")), 6, "total"))


@registered(f"""
WITH {CELLS}, g AS (SELECT p_partkey AS row, p_brand AS "group" FROM part), n AS (SELECT "group", count(*) AS size FROM g GROUP BY 1)
SELECT "group", col, sum(value) / size AS value, size FROM cells JOIN g USING (row) JOIN n USING ("group") GROUP BY "group", col, size
""")
def group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), F.col("p_brand").alias("group"))
    return lookups.group_means(cells(spark, sf_dir), groups).select("group", "col", "value", "size")


# -- neighbours and graphs ----------------------------------------------------------------------------

K = 10
VECTORS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"
KNN = f"""{VECTORS}, d AS (SELECT a.vec_id AS id, b.vec_id AS other, list_distance(a.x, b.x) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id),
knn AS (SELECT id, other, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM d) WHERE rank <= {K})"""
EDGES = KNN + ", e AS (SELECT least(id, other) AS src, greatest(id, other) AS dst, min(distance) AS distance, count(*) AS n FROM knn GROUP BY 1, 2), both AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"
EDGES = EDGES.replace("both AS", "adj AS")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label")


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.exact(vectors(spark, sf_dir), K)


def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(edges.from_neighbours(knn(spark, sf_dir)))


@registered(f"WITH {KNN} SELECT id, rank, other, round(distance, 6) AS distance FROM knn")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(spark, sf_dir).select("id", F.col("rank").cast("long").alias("rank"), "other", r("distance"))


@registered()
def knn_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.by_cells(vectors(spark, sf_dir), K).select("id", F.col("rank").cast("long").alias("rank"), "other", r("distance"))


@registered(f"""
WITH {VECTORS}, d AS (SELECT a.vec_id AS id, b.vec_id AS other, list_distance(a.x, b.x) AS distance FROM v a JOIN v b ON a.label < 5 AND b.label >= 5)
SELECT id, rank, other, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM d) WHERE rank <= 3
""")
def knn_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the first five labels against those of the others."""
    v = vectors(spark, sf_dir)
    return neighbours.between(v.filter("label < 5"), v.filter("label >= 5"), 3).select("id", F.col("rank").cast("long").alias("rank"), "other", r("distance"))


@registered(f"WITH {KNN} SELECT k.id, k.other, round(list_cosine_similarity(a.x, b.x), 6) AS cosine, round(k.distance / 8, 6) AS rms FROM knn k JOIN v a ON k.id = a.vec_id JOIN v b ON k.other = b.vec_id")
def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("id", norm.doubles(F.col("features")).alias("x"))
    pairs = knn(spark, sf_dir).select("id", "other").join(v, "id").join(v.toDF("other", "y"), "other")
    return pairs.select("id", "other", r(neighbours.cosine(F.col("x"), F.col("y")), 6, "cosine"), r(neighbours.rms_distance(F.col("x"), F.col("y")), 6, "rms"))


@registered(f"""
WITH {KNN}, p AS (SELECT vec_id, list_transform(x, lambda y: exp(y)) AS x FROM v), s AS (SELECT vec_id, list_transform(x, lambda y: sqrt(y / list_sum(x))) AS x FROM p)
SELECT k.id, k.other, round(list_distance(a.x, b.x) / sqrt(2), 6) AS hellinger FROM knn k JOIN s a ON k.id = a.vec_id JOIN s b ON k.other = b.vec_id
""")
def hellinger_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("id", norm.array_log_softmax(norm.doubles(F.col("features"))).alias("x"))
    pairs = knn(spark, sf_dir).select("id", "other").join(v, "id").join(v.toDF("other", "y"), "other")
    return pairs.select("id", "other", r(neighbours.hellinger(F.col("x"), F.col("y")), 6, "hellinger"))


@registered(f"WITH {EDGES} SELECT src, dst, round(distance, 6) AS distance FROM e")
def knn_edges_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.from_neighbours(knn(spark, sf_dir)).select("src", "dst", r("distance"))


@registered(f"WITH {EDGES} SELECT src, dst, round(distance, 6) AS distance FROM e WHERE n = 2")
def knn_edges_reciprocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.from_neighbours(knn(spark, sf_dir), reciprocal=True).select("src", "dst", r("distance"))


@registered(f"""
WITH {EDGES}, same AS (SELECT id AS src, other AS dst, distance FROM d JOIN v a ON id = a.vec_id JOIN v b ON other = b.vec_id WHERE id < other AND a.label = b.label),
a AS (SELECT src, dst, (row_number() OVER (ORDER BY distance, src, dst) - 1) / ((count(*) OVER ()) - 1) AS distance, 1 AS s FROM e),
b AS (SELECT src, dst, (row_number() OVER (ORDER BY distance, src, dst) - 1) / ((count(*) OVER ()) - 1) AS distance, 2 AS s FROM same)
SELECT src, dst, round(min(distance), 6) AS distance, bit_or(s) AS source FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2
""")
def edge_union_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours united with pairs of the same label, distances ranked within each source."""
    got = edges.union_within(knn_edges(spark, sf_dir), vectors(spark, sf_dir), "label", 6)
    return got.select("src", "dst", r("distance"), F.col("source").cast("int").alias("source"))


@registered(f"WITH {EDGES} SELECT src, dst, round(exp(-distance / (SELECT median(distance) FROM e)), 6) AS weight FROM e")
def kernel_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.kernel_weights(knn_edges(spark, sf_dir)).select("src", "dst", r("weight"))


@registered(f"""
WITH RECURSIVE {KNN}, m AS MATERIALIZED (SELECT id, list(distance ORDER BY distance, other) AS d, coalesce(min(CASE WHEN distance > 0 THEN distance END), 0) AS rho, log2(count(*) + 1) AS goal, avg(distance) AS mean FROM knn GROUP BY 1),
b AS (SELECT id, 0 AS step, 0::DOUBLE AS low, 'inf'::DOUBLE AS high, 1::DOUBLE AS mid FROM m UNION ALL
      SELECT id, step + 1, CASE WHEN up THEN low ELSE mid END, CASE WHEN up THEN mid ELSE high END, CASE WHEN up THEN (low + mid) / 2 WHEN high = 'inf' THEN 2 * mid ELSE (mid + high) / 2 END
      FROM (SELECT b.*, list_sum(list_transform(d, lambda x: exp(-greatest(x - rho, 0) / mid))) > goal AS up FROM b JOIN m USING (id)) WHERE step < 64),
s AS (SELECT id, rho, greatest(mid, 1e-3 * mean) AS sigma FROM b JOIN m USING (id) WHERE step = 64),
w AS (SELECT id, other, CASE WHEN distance <= rho THEN 1 WHEN sigma <= 0 THEN 0 ELSE exp(-(distance - rho) / sigma) END AS w FROM knn JOIN s USING (id)),
u AS (SELECT least(id, other) AS src, greatest(id, other) AS dst, coalesce(max(CASE WHEN id < other THEN w END), 0) AS a, coalesce(max(CASE WHEN id > other THEN w END), 0) AS b FROM w GROUP BY 1, 2)
SELECT src, dst, round(a + b - a * b, 6) AS weight FROM u WHERE a + b - a * b > 0
""")
def fuzzy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.fuzzy_union(edges.memberships(knn(spark, sf_dir))).select("src", "dst", r("weight"))


@registered("""
WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)
SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1
""")
def copurchase_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With how many other parts each part was ordered."""
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("src")).distinct()
    pairs = parts.join(parts.toDF("l_orderkey", "dst"), "l_orderkey").filter("src < dst").select("src", "dst")
    return edges.degrees(edges.canonical(pairs))


_SHARED = "m AS (SELECT a.src AS src, b.src AS dst, count(*) AS shared FROM adj a JOIN adj b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2)"


@registered(f"WITH {EDGES}, {_SHARED} SELECT e.src, e.dst, coalesce(shared, 0)::BIGINT AS shared FROM e LEFT JOIN m ON e.src = m.src AND e.dst = m.dst")
def shared_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.shared_neighbours(knn_edges(spark, sf_dir))


@registered(f"WITH {EDGES}, {_SHARED} SELECT e.src, e.dst, shared FROM e JOIN m ON e.src = m.src AND e.dst = m.dst WHERE shared >= 2")
def snn_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.prune_by_shared(knn_edges(spark, sf_dir), 2)


@registered(f"WITH {EDGES}, {_SHARED} SELECT src, dst FROM e UNION SELECT src, dst FROM m WHERE shared >= 4")
def snn_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.augment(knn_edges(spark, sf_dir), 4)


@registered(f"""
WITH {EDGES}, {_SHARED}, s AS (SELECT e.src, e.dst, coalesce(shared, 0) AS shared FROM e LEFT JOIN m ON e.src = m.src AND e.dst = m.dst),
t AS (SELECT src, dst, shared, src AS me, dst AS oth FROM s UNION ALL SELECT src, dst, shared, dst, src FROM s)
SELECT DISTINCT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY me ORDER BY shared DESC, oth) AS k FROM t) WHERE k <= 5
""")
def hub_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.cap_degree(knn_edges(spark, sf_dir), 5)


@registered(f"""
WITH {EDGES}, {_SHARED}, g AS (SELECT src AS node, count(*) AS d FROM adj GROUP BY 1),
o AS (SELECT m.src, m.dst, shared, a.d + b.d - shared AS either FROM m JOIN g a ON a.node = m.src JOIN g b ON b.node = m.dst ANTI JOIN e ON e.src = m.src AND e.dst = m.dst),
t AS (SELECT *, src AS me, dst AS oth FROM o UNION ALL SELECT *, dst, src FROM o)
SELECT DISTINCT src, dst, shared, either FROM (SELECT *, row_number() OVER (PARTITION BY me ORDER BY shared / either DESC, shared DESC, oth) AS k FROM t) WHERE k <= 3
""")
def two_hop_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.two_hop(knn_edges(spark, sf_dir), top=3)


@registered(f"WITH {EDGES} SELECT least(a.label, b.label) AS src, greatest(a.label, b.label) AS dst, round(sum(distance), 6) AS weight FROM e JOIN v a ON src = a.vec_id JOIN v b ON dst = b.vec_id WHERE a.label <> b.label GROUP BY 1, 2")
def collapse_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = vectors(spark, sf_dir).select(F.col("id").alias("node"), "label")
    return edges.contract(knn_edges(spark, sf_dir), labels, "distance").select("src", "dst", r("weight"))


@registered(f"""
WITH {EDGES}, w AS (SELECT sum(distance) AS w FROM e), i AS (SELECT sum(distance) AS i FROM e JOIN v a ON src = a.vec_id JOIN v b ON dst = b.vec_id WHERE a.label = b.label),
s AS (SELECT sum(n * n)::DOUBLE AS q FROM (SELECT label, count(*) AS n FROM v GROUP BY 1))
SELECT round((2 * i - 0.05 * q) / (2 * w), 6) AS cpm FROM w, i, s
""")
def cpm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = vectors(spark, sf_dir).select(F.col("id").alias("node"), "label", F.lit(1.0).alias("weight"))
    return edges.quality(knn_edges(spark, sf_dir).withColumnRenamed("distance", "weight"), nodes.select("node", "label"), nodes.select("node", "weight"), 0.05).select(r("cpm"))


NEAREST = KNN.replace(f"rank <= {K})", "rank <= 1)")


@registered(f"""
WITH RECURSIVE {NEAREST}, adj AS (SELECT id AS a, other AS b FROM knn UNION SELECT other, id FROM knn),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT x.a, y.b FROM reach x JOIN adj y ON x.b = y.a), root AS (SELECT a, min(b) AS r FROM reach GROUP BY 1)
SELECT a AS node, dense_rank() OVER (ORDER BY r) - 1 AS component FROM root
""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return traverse.connected_components(edges.from_neighbours(neighbours.exact(v, 1)), v.select(F.col("id").alias("node")))


@registered(f"""
WITH RECURSIVE {EDGES}, walk AS (SELECT (SELECT min(vec_id) FROM v) AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN adj ON node = src WHERE depth < 12)
SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY 1
""")
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = vectors(spark, sf_dir).agg(F.min("id")).first()[0]
    return traverse.depths(knn_edges(spark, sf_dir), start).select("node", "depth")


@registered(f"""
WITH RECURSIVE {EDGES}, c AS (SELECT 0 AS step, src, dst FROM adj UNION ALL
SELECT step + 1, src, dst FROM (SELECT *, count(*) OVER (PARTITION BY src) AS a, count(*) OVER (PARTITION BY dst) AS b FROM c) WHERE a >= 8 AND b >= 8 AND step < 200)
SELECT src, dst FROM c WHERE step = 200 AND src < dst
""")
def k_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.core(knn_edges(spark, sf_dir), 8)


@registered(f"""
WITH RECURSIVE {EDGES}, deg AS MATERIALIZED (SELECT src AS node, count(*) AS d FROM adj GROUP BY 1), ways AS MATERIALIZED (SELECT src AS node, dst AS goes, TRUE AS pushed FROM adj UNION ALL SELECT node, node, FALSE FROM deg),
p AS (SELECT 0 AS step, node AS source, node, 1::DOUBLE AS r FROM deg UNION ALL
      SELECT step + 1, source, goes, sum(CASE WHEN pushed THEN 0.85 * r / d ELSE r END)
      FROM (SELECT p.*, d, max(r / d) OVER (PARTITION BY source) AS most FROM p JOIN deg USING (node)) t JOIN ways w ON w.node = t.node AND w.pushed = (r >= 1e-4 * d) WHERE most >= 1e-4 GROUP BY step, source, goes),
s AS (SELECT source, node, sum(0.15 * r) AS score FROM p JOIN deg USING (node) WHERE r >= 1e-4 * d GROUP BY 1, 2)
SELECT source, rank::INTEGER AS rank, node, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, node) AS rank FROM s WHERE node <> source) WHERE rank <= 5
""")
def ppr_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.personal_ranks(knn_edges(spark, sf_dir), 5).select("source", "rank", "node", r("score"))


@registered(f"""
WITH RECURSIVE {EDGES}, k AS MATERIALIZED (SELECT src, dst, distance, row_number() OVER (ORDER BY distance, src, dst) AS rank FROM e), ways AS MATERIALIZED (SELECT src AS node, dst AS goes, rank FROM k UNION ALL SELECT dst, src, rank FROM k),
lighter AS (SELECT rank AS edge, src AS node FROM k UNION SELECT edge, goes FROM lighter JOIN ways USING (node) WHERE ways.rank < edge)
SELECT src, dst, round(distance, 6) AS weight FROM k WHERE NOT EXISTS (SELECT 1 FROM lighter WHERE edge = k.rank AND node = k.dst)
""")
def spanning_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.spanning_tree(knn_edges(spark, sf_dir).withColumnRenamed("distance", "weight")).select("src", "dst", r("weight"))


@registered()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = cut_lineage(edges.kernel_weights(knn_edges(spark, sf_dir)).select("src", "dst", "weight"))
    return traverse.communities(weighted, vectors(spark, sf_dir).select(F.col("id").alias("node")))


@registered()
def communities_cpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the constant Potts model, at the resolution that stands for a modularity of 1 on equal degrees."""
    weighted = cut_lineage(edges.kernel_weights(knn_edges(spark, sf_dir)).select("src", "dst", "weight"))
    mean = weighted.agg(F.sum("weight")).first()[0] / (edges.degrees(weighted).count() ** 2) * 2  # of a pair of nodes
    return traverse.communities(weighted, vectors(spark, sf_dir).select(F.col("id").alias("node")), resolution=mean, objective="cpm")


@registered("SELECT vec_id AS node, true AS whole, true AS least_name, true AS no_worse FROM embeddings")
def refined_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector: is its community connected and named by its least member, and are all together worth no less than the given labels are?"""
    graph = cut_lineage(edges.kernel_weights(knn_edges(spark, sf_dir)).select("src", "dst", "weight"))
    points = vectors(spark, sf_dir).select(F.col("id").alias("node"), F.lit(1.0).alias("weight"), "label")
    mean = graph.agg(F.sum("weight")).first()[0] / max(1, points.count()) ** 2 * 2  # of a pair of nodes
    labels = refined.refined_communities(graph, points.select("node"), resolution=mean, passes=1)
    worth = lambda found: edges.quality(graph, found, points.select("node", "weight"), mean * 2 * graph.agg(F.sum("weight")).first()[0])
    better = worth(labels).withColumnRenamed("cpm", "own").join(F.broadcast(worth(points.select("node", "label"))))  # one row each
    parts = refined.connected_parts(graph, labels).withColumnRenamed("label", "part")
    groups = with_totals(labels.join(parts, "node"), ["label"], first=F.min("part"), last=F.max("part"), least=F.min("node"))
    checked = groups.select("node", (F.col("first") == F.col("last")).alias("whole"), (F.col("label") == F.col("least")).alias("least_name"))
    return checked.join(F.broadcast(better.select((F.col("own") >= F.col("cpm")).alias("no_worse"))))


LINK = 1.1


@registered(f"""
WITH RECURSIVE {EDGES}, k AS MATERIALIZED (SELECT src, dst, distance, row_number() OVER (ORDER BY distance, src, dst) AS rank FROM e WHERE distance < {LINK}), ways AS MATERIALIZED (SELECT src AS node, dst AS goes, rank FROM k UNION ALL SELECT dst, src, rank FROM k),
lighter AS (SELECT rank AS edge, src AS node FROM k UNION SELECT edge, goes FROM lighter JOIN ways USING (node) WHERE ways.rank < edge)
SELECT src, dst, round(distance, 6) AS distance FROM k WHERE NOT EXISTS (SELECT 1 FROM lighter WHERE edge = k.rank AND node = k.dst)
""")
def branching_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of the branching of nearest neighbours, whose arcs weigh as much in either direction: those of a spanning forest."""
    arcs = edges.both_ways(knn_edges(spark, sf_dir)).select("src", "dst", (-F.col("distance")).alias("weight"))
    found = branching.max_branching(arcs, vectors(spark, sf_dir).select(F.col("id").alias("node"), F.lit(-LINK).alias("affinity")))
    links = found.filter("parent IS NOT NULL")
    return links.select(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"), r(-F.col("weight"), 6, "distance"))


@registered()
def coarsened_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth as many groups as vectors, by heavy edges of the fuzzy graph, and the means of the vectors in each."""
    points = vectors(spark, sf_dir)
    graph = cut_lineage(edges.fuzzy_union(edges.memberships(knn(spark, sf_dir))))
    labels = traverse.coarsened(graph, points.select(F.col("id").alias("node")), max(1, points.count() // 10))
    means = lookups.group_means(lookups.melt(points).select("row", "col", "value"), labels.toDF("row", "group"))
    return means.select("group", "col", r("value"), "size")


@registered(f"WITH {EDGES} SELECT src, dst, round(40 * (2 - distance) / (SELECT max(2 - distance) FROM e), 4) AS expected, true AS near, true AS spread FROM e")
def edge_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each edge of nearest neighbours, weighed by 2 − distance, is used in 40 rounds, and in the first half of them."""
    weighed = knn_edges(spark, sf_dir).withColumn("weight", 2 - F.col("distance"))
    shares = weighed.withColumn("share", F.col("weight") / weighed.agg(F.max("weight")).first()[0])
    uses = lambda rounds: sum((layout.used_in(k, "share", 42, "src", "dst").cast("int") for k in rounds), F.lit(0))
    off = lambda rounds: F.abs(uses(rounds) - len(rounds) * F.col("share")) < 1
    return shares.select("src", "dst", r(40 * F.col("share"), 4, "expected"), off(range(40)).alias("near"), off(range(20)).alias("spread"))


@registered(f"""
WITH {EDGES}, g AS (SELECT label, k, avg(y) AS m FROM (SELECT label, generate_subscripts(x, 1) AS k, unnest(x) AS y FROM v) GROUP BY 1, 2), means AS (SELECT label, list(m ORDER BY k) AS m FROM g GROUP BY 1),
own AS (SELECT vec_id AS node, label FROM v), near AS (SELECT DISTINCT a.label, b.label AS "group" FROM adj JOIN own a ON src = a.node JOIN own b ON dst = b.node UNION SELECT label, label FROM own),
apart AS (SELECT vec_id, list_distance(x, m) AS d, n."group"::DOUBLE AS x, (n."group" * n."group")::DOUBLE AS y FROM v JOIN near n USING (label) JOIN means ON means.label = n."group"),
s AS (SELECT *, max(d) FILTER (k <= 5) OVER (PARTITION BY vec_id) AS sigma FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, x) AS k FROM apart)), w AS (SELECT *, exp(-power(d / sigma, 10)) AS w FROM s)
SELECT vec_id AS node, round(sum(w * x) / sum(w), 4) AS x, round(sum(w * y) / sum(w), 4) AS y FROM w GROUP BY 1
""")
def placed_by_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors placed by the labels near them, each label at (label, label²)."""
    points = vectors(spark, sf_dir)
    labels = points.select(F.col("id").alias("node"), "label")
    means = clusters.means_of(points.select("label", F.transform("features", lambda x: x.cast("double")).alias("v")), "label")
    places = labels.select(F.col("label").alias("node")).distinct().select("node", F.col("node").cast("double").alias("x"), (F.col("node") * F.col("node")).cast("double").alias("y"))
    linked = edges.contract(knn_edges(spark, sf_dir).withColumn("weight", F.lit(1.0)), labels)
    return layout.place_members(points, labels, means, linked, places).select("node", r("x", 4), r("y", 4))


@registered("SELECT vec_id AS node, true AS placed FROM embeddings")
def multilevel_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors laid out from coarse to fine over the fuzzy graph of their neighbours."""
    graph = cut_lineage(edges.fuzzy_union(edges.memberships(knn(spark, sf_dir))))
    places = layout.multilevel_layout(vectors(spark, sf_dir), graph, rounds=20, refine=5)
    sound = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e6)
    return places.select("node", (sound("x") & sound("y")).alias("placed"))


@registered(f"WITH {KNN} SELECT id, rank, other, round(distance, 6) AS distance FROM knn WHERE id % 50 = 0")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all vectors is saved; then every fiftieth is searched by its name, in all cells, which is exact."""
    path = _file(spark, "")
    cell_index.build(vectors(spark, sf_dir), path)
    names = vectors(spark, sf_dir).filter("id % 50 = 0").select("id")
    found = cell_index.search_by_name(spark, path, names, K, probes=cell_index.MOST_CELLS)
    return found.select("id", F.col("rank").cast("long").alias("rank"), "other", r("distance"))


@registered(f"WITH {VECTORS} SELECT vec_id AS id, round(list_inner_product(x, x), 4) AS size FROM v")
def landmark_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates from as many landmarks as twice the width, which span the vectors, so that lengths are kept."""
    basis = linear.nystrom_basis(vectors(spark, sf_dir), 128)
    return basis.select("id", r(norm.dot(F.col("basis"), F.col("basis")), 4, "size"))


@registered("SELECT vec_id AS id, true AS convex, true AS no_worse FROM embeddings")
def archetype_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are the weights of four archetypes convex, and is the loss no larger than that of the rows which they started at?"""
    points = vectors(spark, sf_dir)
    found = archetypes.fit(points, 4, rounds=3)
    weighed = clusters.simplex_weights(points, found.places)
    total = F.aggregate("weights", F.lit(0.0), lambda s, x: s + x)
    convex = F.forall("weights", lambda x: x >= -1e-9) & (F.abs(total - 1) < 1e-9)
    return weighed.select("id", convex.alias("convex"), F.lit(found.losses[-1] <= found.losses[0]).alias("no_worse"))


@registered("SELECT vec_id AS id, true AS on_curve FROM embeddings")
def lineage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors on the principal curves of a tree of eight nodes: is each row's time on the curve of one of its lineages?"""
    points = vectors(spark, sf_dir)
    nodes, links = trajectory.principal_graph(points, 8, rounds=5)
    fitted = curves.fit_curves(points, nodes, links, 0, rounds=3)
    ends = F.array(*(F.lit(float(a[-1])) for a in fitted.along))
    time = F.get("times", F.col("branch"))
    sound = (F.col("time") == time) & (F.col("time") >= 0) & (F.col("time") <= F.get(ends, F.col("branch")) + 1e-9) & F.get("shares", F.col("branch")).isNotNull()
    return curves.curve_times(points, fitted).select("id", F.coalesce(sound, F.lit(False)).alias("on_curve"))


@registered("""
WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS no FROM orders)
SELECT no // 64 AS batch, count(*) AS size, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS shuffled FROM k GROUP BY 1
""")
def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in batches of 64, in their order; and how many orders the batch of the same number has in a shuffle."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    inorder = epochs.ordered_batches(orders, F.col("o_orderkey"), 64).groupBy("batch").agg(F.count("*").alias("size"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    shuffled = epochs.shuffled_batches(orders, "o_orderkey", 64).groupBy("batch").agg(F.count_distinct("o_orderkey").alias("shuffled"))
    return inorder.join(shuffled, "batch")


# -- sums over vectors --------------------------------------------------------------------------------


@registered(f"""
WITH {VECTORS}, x AS (SELECT vec_id, generate_subscripts(x, 1) - 1 AS k, unnest(x) AS y FROM v)
SELECT a.k::INTEGER AS i, b.k::INTEGER AS j, round(sum(a.y * b.y), 6) + 0.0 AS g FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.k <= b.k GROUP BY 1, 2
""")
def geometry_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.gram(vectors(spark, sf_dir)).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), r("g"))


@registered(f"""
WITH {VECTORS}, x AS (SELECT vec_id, generate_subscripts(x, 1) AS k, unnest(x) AS y FROM v), g AS (SELECT a.k AS i, b.k AS j, sum(a.y * b.y) AS g FROM x a JOIN x b USING (vec_id) GROUP BY 1, 2)
SELECT (SELECT count(*) FROM v) AS n, round(sum(CASE WHEN i = j THEN g ELSE 0 END) ** 2 / sum(g * g), 4) AS participation FROM g
""")
def participation_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.geometry(vectors(spark, sf_dir)).select("n", r("participation", 4))


@registered()
def principal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.scores(vectors(spark, sf_dir), 3).select("id", *(r(F.element_at("scores", k + 1), 4, f"pc{k + 1}") for k in range(3)))


@registered(f"""
WITH {VECTORS}, c AS (SELECT label, k, avg(y) AS m FROM (SELECT label, generate_subscripts(x, 1) AS k, unnest(x) AS y FROM v) GROUP BY 1, 2), m AS (SELECT label, list(m ORDER BY k) AS m FROM c GROUP BY 1),
d AS (SELECT vec_id, m.label, list_distance(x, m) ** 2 AS d FROM v, m)
SELECT vec_id AS id, first(label ORDER BY d, label)::INTEGER AS cluster, round(min(d), 6) AS distance FROM d GROUP BY 1
""")
def kmeans_assign_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector to the nearest mean of a label."""
    import numpy as np

    v = vectors(spark, sf_dir)
    means = clusters.means_of(v.select("label", norm.doubles(F.col("features")).alias("v")), "label").orderBy("label").collect()
    return clusters.assign(v, np.array([m["mean"] for m in means])).select("id", "cluster", r("distance"))


@registered(f"WITH {VECTORS} SELECT label, k::INTEGER AS place, n, round(avg(y), 6) + 0.0 AS mean FROM (SELECT label, generate_subscripts(x, 1) - 1 AS k, unnest(x) AS y, count(*) OVER (PARTITION BY label) AS n FROM v) GROUP BY 1, 2, 3")
def centroid_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = clusters.means_of(vectors(spark, sf_dir).select("label", norm.doubles(F.col("features")).alias("v")), "label")
    return means.select("label", "n", F.posexplode("mean").alias("place", "m")).select("label", "place", "n", r("m", 6, "mean"))


@registered()
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.kmeans(vectors(spark, sf_dir), 10).select("id", "cluster", r("distance"))


@registered()
def batch_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = clusters.harmonise(vectors(spark, sf_dir), "label", k=5)
    return got.select("id", r(norm.total(F.col("corrected")), 6, "total"))


@registered()
def anchor_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as mixtures of five that span the others."""
    import numpy as np

    v = vectors(spark, sf_dir)
    found = clusters.anchors(v, 5)
    rows = {x.id: x.features for x in v.filter(F.col("id").isin(found)).collect()}  # the anchors alone
    return clusters.simplex_weights(v, np.array([rows[i] for i in found], float)).select("id", r("rss"), r(F.array_max("weights"), 6, "top"))


@registered(f"""
WITH {KNN}, p AS (SELECT vec_id AS other, x[1] AS x, x[2] AS y FROM v), s AS (SELECT *, max(distance) OVER (PARTITION BY id) AS sigma FROM knn),
w AS (SELECT id, other, CASE WHEN sigma > 0 THEN exp(-((distance / sigma) ** 40)) ELSE 1 END AS w FROM s)
SELECT id, round(sum(w * x) / sum(w), 6) + 0.0 AS x, round(sum(w * y) / sum(w), 6) + 0.0 AS y FROM w JOIN p USING (other) GROUP BY 1
""")
def nystrom_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = vectors(spark, sf_dir).select(F.col("id").alias("other"), norm.doubles(F.col("features"))[0].alias("x"), norm.doubles(F.col("features"))[1].alias("y"))
    return linear.nystrom_place(knn(spark, sf_dir), places).select("id", r("x"), r("y"))


@registered(f"""
WITH {VECTORS}, d AS (SELECT a.vec_id AS id, b.vec_id AS other, list_distance(a.x, b.x) AS distance FROM v a JOIN v b ON a.label < 5 AND b.label >= 5),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM d) WHERE rank <= 5),
w AS (SELECT id, other, exp(-((distance / greatest(max(distance) OVER (PARTITION BY id), 1e-6)) ** 2)) AS w FROM k)
SELECT id, round(sum(w * x[1]) / sum(w), 6) + 0.0 AS x, round(sum(w * x[2]) / sum(w), 6) + 0.0 AS y FROM w JOIN v ON other = vec_id GROUP BY 1
""")
def placed_by_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the first five labels, placed by their nearest ones among the others."""
    v = vectors(spark, sf_dir)
    near = neighbours.between(v.filter("label < 5"), v.filter("label >= 5"), 5)
    places = v.select(F.col("id").alias("other"), norm.doubles(F.col("features"))[0].alias("x"), norm.doubles(F.col("features"))[1].alias("y"))
    return linear.nystrom_place(near, places, 2.0).select("id", r("x"), r("y"))


@registered(f"""
WITH {VECTORS}, e AS (SELECT vec_id, label, generate_subscripts(x, 1) AS k, unnest(x) AS y FROM v),
m AS (SELECT label, k, avg(y) AS y FROM e GROUP BY 1, 2), t AS (SELECT label, k, y - avg(y) OVER (PARTITION BY k) AS y, dense_rank() OVER (ORDER BY label) - 1 AS topic FROM m),
s AS (SELECT vec_id AS id, topic, sum(e.y * t.y) AS s FROM e JOIN t USING (k) GROUP BY 1, 2)
SELECT id, topic::INTEGER AS topic, round(s - ln(sum(exp(s)) OVER (PARTITION BY topic)), 5) AS log_share FROM s
""")
def topic_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as features, the labels' means as topics."""
    import numpy as np

    v = vectors(spark, sf_dir).select("id", "label", norm.doubles(F.col("features")).alias("features"))
    means = clusters.means_of(v.select("label", F.col("features").alias("v")), "label").orderBy("label").collect()  # a row for each label
    return linear.topic_dictionary(v, np.array([m["mean"] for m in means])).select("id", F.col("topic").cast("int").alias("topic"), r("value", 5, "log_share"))


@registered(f"""
WITH {VECTORS}, d AS (SELECT list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.vec_id < b.vec_id)
SELECT round(max(d), 6) AS quantile FROM (SELECT d FROM d ORDER BY d LIMIT (SELECT 1 + floor(0.25 * (count(*) - 1))::BIGINT FROM d))
""")
def distance_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all vectors: all pairs of up to 632 rows (which the SQL has), of more rows 200,000 pairs drawn from all."""
    return neighbours.distance_quantile(vectors(spark, sf_dir), 0.25).select(r("quantile"))


@registered("WITH m AS (SELECT p_partkey, coalesce(avg(l_quantity), 0) AS v FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1) SELECT p_partkey, round(ln(greatest(v / sum(v) OVER (), 1e-3 / count(*) OVER ())), 6) AS log_share FROM m")
def log_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    means = table(spark, sf_dir, "part").select("p_partkey").join(lines, "p_partkey", "left").groupBy("p_partkey").agg(F.avg("l_quantity").alias("value"))
    return norm.log_background(means).select("p_partkey", r("log_share"))


@registered()
def diffusion_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = edges.kernel_weights(knn_edges(spark, sf_dir)).select("src", "dst", "weight")
    return layout.diffusion_map(weighted).select("node", r("x"), r("y"))


@registered()
def force_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = edges.kernel_weights(knn_edges(spark, sf_dir)).select("src", "dst", "weight")
    start = vectors(spark, sf_dir).select(F.col("id").alias("node"), (20 * sampling.uniform(1, "id") - 10).alias("x"), (20 * sampling.uniform(2, "id") - 10).alias("y"))
    return layout.attract_repel(weighted, start).select("node", r("x", 3), r("y", 3))


@registered()
def pseudotime(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    nodes, tree = trajectory.principal_graph(v, 12)
    return trajectory.pseudotime(v, nodes, tree, 0).select("id", "edge", r("along", 4), r("time", 4))


# -- posteriors and likelihoods -----------------------------------------------------------------------


def posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    keys = c.select(F.col("row"), F.col("col").alias("column"), F.col("value").alias("da"), (F.col("price") / 1000).alias("db"))
    return gamma.add(gamma.prior(keys, 1.0, 1.0), keys)


@registered(f"WITH {CELLS}, p AS (SELECT row, col AS column, 1 + value AS a, 1 + price / 1000 AS b FROM cells) SELECT row, \"column\", round(a / b, 6) AS mean, round(sqrt(a) / b, 6) AS sd, round((a - 1) / (b - 1), 6) AS evidence FROM p".replace("AS column", 'AS "column"'))
def gamma_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = gamma.evidence_mean(gamma.calibrate(posterior(spark, sf_dir), logs=False), 1.0, 1.0)
    return got.select("row", "column", r("mean"), r("sd"), r("evidence"))


@registered(f"""
WITH {CELLS}, p AS (SELECT row, col, 1 + value AS a, 1 + price / 1000 AS b, 21 + value AS y FROM cells),
s AS (SELECT *, list_sum(list_transform(range(20), lambda i: 1 / (a + i))) AS s1, list_sum(list_transform(range(20), lambda i: 1 / ((a + i) * (a + i)))) AS s2 FROM p)
SELECT row, col AS "column", round(ln(y) - 1 / (2 * y) - 1 / (12 * y ** 2) + 1 / (120 * y ** 4) - 1 / (252 * y ** 6) - s1 - ln(b), 6) + 0.0 AS log_mean,
       round(sqrt(1 / y + 1 / (2 * y ** 2) + 1 / (6 * y ** 3) - 1 / (30 * y ** 5) + 1 / (42 * y ** 7) + s2), 6) AS log_sd FROM s
""")
def gamma_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gamma.calibrate(posterior(spark, sf_dir)).select("row", "column", r("log_mean"), r("log_sd"))


@registered()
def gamma_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gamma.sample(posterior(spark, sf_dir)).select("row", "column", r("draw"))


_LG = "(-0.0810614667 - ({0}) - ln({0}) + (({0}) + 0.5) * ln(1 + ({0})))"
RATES = f"{CELLS}, t AS (SELECT row, value AS x, (sum(value) OVER (PARTITION BY row)) / (count(*) OVER (PARTITION BY row)) AS mu FROM cells)"


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_totals(cells(spark, sf_dir).select("row", "col", F.col("value").alias("x")), ["row"], mu=F.avg("x"))


@registered(f"WITH {RATES} SELECT row, round(sum(x * ln(mu) - mu), 5) AS llik FROM t GROUP BY 1")
def poisson_llik(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.summed(rates(spark, sf_dir), ["row"], likelihood.poisson(F.col("x"), F.col("mu"))).select("row", r("llik", 5))


@registered(f"WITH {RATES} SELECT row, round(sum({_LG.format('x + exp(1.0)')} - {_LG.format('exp(1.0)')} - {_LG.format('x + 1')} + exp(1.0) * ln(exp(1.0) / (exp(1.0) + mu)) + x * ln(mu / (exp(1.0) + mu))), 5) AS llik FROM t GROUP BY 1")
def nb_llik(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.summed(rates(spark, sf_dir), ["row"], likelihood.negative_binomial(F.col("x"), F.col("mu"), F.lit(1.0))).select("row", r("llik", 5))


@registered("""
WITH t AS (SELECT l_orderkey AS row, l_returnflag AS module, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2), sizes AS (SELECT row, sum(x) AS size FROM t GROUP BY 1),
seen AS (SELECT l_orderkey AS row, l_returnflag AS module, sum(l_quantity) AS seen, 0.5 AS seen_share FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
m AS (SELECT l_returnflag AS module, count(*) AS n FROM lineitem GROUP BY 1), beta AS (SELECT module, n / sum(n) OVER () AS rate FROM m),
parts AS (SELECT s.row, b.module, rate, greatest(coalesce(x, 0) - coalesce(seen, 0), 0) AS unseen, 1 - coalesce(seen_share, 0) AS share FROM sizes s CROSS JOIN beta b LEFT JOIN t ON t.row = s.row AND t.module = b.module LEFT JOIN seen ON seen.row = s.row AND seen.module = b.module)
SELECT row, round(sum(unseen * ln(rate * share + 1e-20)), 4) AS llik, count(*) AS scored FROM parts GROUP BY 1
""")
def unseen_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of an order by return flag that its finished lines don't show, under the flags' shares of all lines."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_returnflag").alias("module"), F.concat("l_returnflag", "l_linestatus").alias("feature"), "l_linestatus", F.col("l_quantity").alias("x"))
    modules = with_totals(lines.groupBy("module").agg(F.count("*").alias("n")), [], all=F.sum("n")).select(F.lit(0).alias("topic"), "module", (F.col("n") / F.col("all")).alias("beta"))
    theta = lines.select("row").distinct().select("row", F.lit(0).alias("topic"), F.lit(1.0).alias("theta"))
    visible = lines.filter("l_linestatus = 'F'").groupBy("row", "feature").agg(F.sum("x").alias("x"))
    members = lines.select("module").distinct().select(F.concat("module", F.lit("F")).alias("feature"), "module", F.lit(0.5).alias("share"))
    parts = likelihood.unseen_parts(theta, modules, lines.select("row", "module", "x"), visible, members)
    return likelihood.score_unseen_multinomial(parts).select("row", r("llik", 4), "scored")


@registered(f"WITH {RATES} SELECT row, round({_LG.format('sum(mu)')} - {_LG.format('sum(x) + sum(mu)')} + sum({_LG.format('x + mu')} - {_LG.format('mu')}), 4) AS llik FROM t GROUP BY 1")
def dirichlet_llik(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.dirichlet_multinomial(rates(spark, sf_dir), ["row"], "x", "mu").select("row", r("llik", 4))


@registered(f"WITH {RATES}, s AS (SELECT row, x, ln(mu + x) AS s, max(ln(mu + x)) OVER (PARTITION BY row) AS top FROM t) SELECT row, round(sum(x) * (max(top) + ln(sum(exp(s - top)))) - sum(x * s), 5) + 0.0 AS nll FROM s GROUP BY 1")
def multinomial_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rates(spark, sf_dir).withColumn("s", F.log(F.col("mu") + F.col("x")))
    return likelihood.multinomial_profiled(scored, ["row"], "x", "s").select("row", r("nll", 5))


@registered(f"WITH {KNN} SELECT round(sum(greatest(1 - distance / 1.5, 0) ** 2) / count(*), 6) AS loss FROM knn")
def pair_hinge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likelihood.pair_hinge(knn(spark, sf_dir).withColumn("w", F.lit(1.0)), "distance", "w", 1.5).select(r("loss"))


@registered("SELECT x, round(-0.0810614667 - x - ln(x) + (x + 0.5) * ln(1 + x), 9) AS lg FROM (SELECT DISTINCT l_quantity AS x FROM lineitem)")
def approximate_lgamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x")).distinct().select("x", r(approx_lgamma(F.col("x")), 9, "lg"))


@registered()
def hidden_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An eighth of each vector's places, hidden by a keyed draw."""
    return likelihood.hidden_cells(vectors(spark, sf_dir).select(F.col("id").alias("row")), 64, 0.125)


# -- array functions ----------------------------------------------------------------------------------


@registered(f"WITH {VECTORS}, e AS (SELECT vec_id, generate_subscripts(x, 1) - 1 AS place, unnest(x) AS y FROM v), z AS (SELECT vec_id, sum(exp(y)) AS z FROM e GROUP BY 1) SELECT vec_id AS id, place::INTEGER AS place, round(0.9 * exp(y) / z + 0.1 / 64, 7) AS smoothed FROM e JOIN z USING (vec_id)")
def smoothed_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    smooth = norm.smooth_topics(norm.array_log_softmax(norm.doubles(F.col("features"))), 0.1)
    return vectors(spark, sf_dir).select("id", F.posexplode(smooth).alias("place", "y")).select("id", "place", r(F.exp("y"), 7, "smoothed"))


@registered(f"""
WITH {VECTORS}, e AS (SELECT vec_id, generate_subscripts(x, 1) AS k, unnest(x) AS y FROM v),
s AS (SELECT *, sum(CASE WHEN k < 64 THEN -ln(1 + exp(y)) ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY k) AS rest FROM e)
SELECT vec_id AS id, (k - 1)::INTEGER AS place, round(CASE WHEN k < 64 THEN y + rest ELSE rest END, 6) + 0.0 AS log_share FROM s
""")
def stick_breaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = norm.stick_breaking(norm.doubles(F.col("features")))
    return vectors(spark, sf_dir).select("id", F.posexplode(broken).alias("place", "y")).select("id", "place", r("y", 6, "log_share"))


@registered(f"""
WITH {VECTORS}, z AS (SELECT vec_id, x, unnest(list_sort(list_transform(x, lambda y: 8 * y), 'DESC')) AS z, generate_subscripts(x, 1) AS k FROM v), c AS (SELECT vec_id, z, k, sum(z) OVER (PARTITION BY vec_id ORDER BY k) AS s FROM z),
t AS (SELECT vec_id, max(k) AS k FROM c WHERE 1 + k * z > s GROUP BY 1), u AS (SELECT c.vec_id, (s - 1) / c.k AS tau FROM c JOIN t ON c.vec_id = t.vec_id AND c.k = t.k)
SELECT v.vec_id AS id, len(list_filter(x, lambda y: 8 * y > tau))::BIGINT AS support, round(greatest(list_max(x) * 8 - tau, 0), 6) AS top FROM v JOIN u USING (vec_id)
""")
def sparsemax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", norm.sparsemax(F.transform(norm.doubles(F.col("features")), lambda x: 8 * x)).alias("p"))
    return rows.select("id", F.size(F.filter("p", lambda x: x > 0)).cast("long").alias("support"), r(F.array_max("p"), 6, "top"))


@registered("SELECT p_partkey, round(least(v, 0) - ln(1 + exp(-abs(v))), 9) + 0.0 AS log_sigmoid, round(8 * tanh(v / 8), 9) + 0.0 AS clamped, round(sin(p_size), 9) + 0.0 AS s0, round(cos(p_size / 10.0), 9) + 0.0 AS c1 FROM (SELECT *, p_size - 25.0 AS v FROM part)".replace("p_size / 10.0", "p_size / (10000.0 ** 0.5)"))
def value_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("v", F.col("p_size") - 25.0).withColumn("e", norm.positional_embedding(F.col("p_size").cast("double"), 4))
    return parts.select("p_partkey", r(norm.log_sigmoid(F.col("v")), 9, "log_sigmoid"), r(norm.soft_clamp(F.col("v")), 9, "clamped"), r(F.col("e")[0], 9, "s0"), r(F.col("e")[1], 9, "c1"))


# -- draws and streams --------------------------------------------------------------------------------


@registered()
def keyed_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bootstrap(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@registered()
def thinned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.poisson_thin(cells(spark, sf_dir).select("row", "col", "value"), 0.5, ["row", "col"])


@registered("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, sum(CASE WHEN value > 0 THEN 1 ELSE 0 END)::BIGINT AS nnz, round(sum(value), 6) AS tot, round(avg(value), 6) AS mu, round(stddev_pop(value), 6) AS sig FROM events GROUP BY 1, 2, 3")
def streaming_running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = streams.windowed_stats(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", "1 hour", "2 hours")
    return got.select("start", "end", "event_type", "nnz", r("tot"), r("mu"), r("sig"))


@registered("""
WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n, round(sum(value), 6) AS tot FROM s GROUP BY user_id, k
""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "6 hours", "1 day", "value").select("start", "end", "user_id", "n", r("tot"))


@registered()
def running_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.running_quantile_batch(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 0.9).select("user_id", "n", r("quantile"))


# -- rows and columns of a matrix ---------------------------------------------------------------------


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), norm.doubles(F.col("embedding")).alias("features"))


def _melted(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "row", F.posexplode("features").alias("place", "value")).select(*more, "row", "place", r("value"))


def _unnested(x: str, more: str = "") -> str:
    return f"SELECT {more}vec_id AS row, (generate_subscripts({x}, 1) - 1)::INTEGER AS place, round(unnest({x}), 6) + 0.0 AS value FROM "


@registered(f"WITH {VECTORS} " + _unnested("[x[3], x[1], x[64], x[1]]") + "v")
def subset_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _melted(lookups.subset_columns(matrix(spark, sf_dir), [2, 0, 63, 0]))


@registered(f"WITH {VECTORS}, o AS (SELECT unnest([5, 3, 8, 3]) AS vec_id, generate_subscripts([5, 3, 8, 3], 1) - 1 AS no) " + _unnested("x", "no, ") + "v JOIN o USING (vec_id)")
def subset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _melted(lookups.subset_rows(matrix(spark, sf_dir), [5, 3, 8, 3]).withColumnRenamed("place", "no"), "no")


@registered(f"WITH {VECTORS} " + _unnested("(x[1:1] || [x[64]] || x[3:4] || [x[63]] || x[6:64])") + "v")
def assign_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with its last two values at places 1 and 4."""
    m = matrix(spark, sf_dir)
    return _melted(lookups.assign_columns(m, lookups.subset_columns(m, [63, 62]), [1, 4]))


@registered(f"WITH {VECTORS} " + _unnested("(x || [x[2], x[1]])") + "v")
def concatenate_horizontal(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir)
    return _melted(lookups.bind_columns(m, lookups.subset_columns(m, [1, 0])))


@registered(f"WITH {VECTORS} " + _unnested("x") + "v UNION ALL " + _unnested("x").replace("vec_id AS", "-vec_id - 1 AS") + "v")
def concatenate_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir)
    return _melted(lookups.bind_rows(m, m.withColumn("row", -F.col("row") - 1)))


@registered(f"WITH {KNN} SELECT knn.id, knn.rank, vec_id AS row, round(list_sum(x), 5) + 0.0 AS total FROM knn JOIN v ON other = vec_id")
def gather_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of each row's neighbours."""
    got = lookups.gather_rows(matrix(spark, sf_dir), knn(spark, sf_dir).select("id", F.col("rank").cast("long").alias("rank"), F.col("other").alias("row")))
    return got.select("id", "rank", "row", r(norm.total(F.col("features")), 5, "total"))


@registered('SELECT DISTINCT o_orderpriority AS "group" FROM orders')
def unique_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.unique_groups(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("group")))


@registered('SELECT label AS "group", vec_id AS id FROM embeddings')
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.members(vectors(spark, sf_dir).select("id", F.col("label").alias("group")))


@registered("WITH f AS (SELECT o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1), n AS (SELECT o_orderpriority, row_number() OVER (ORDER BY first) - 1 AS compact FROM f) SELECT o_orderkey AS id, o_orderpriority AS label, compact::INTEGER AS compact FROM orders JOIN n USING (o_orderpriority)")
def compact_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))
    return clusters.compact_labels(labels).select("id", "label", "compact")


@registered("WITH b AS (SELECT o_orderkey AS id, coalesce(sum(len(o_orderpriority)) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders) SELECT id, (before // 4096)::BIGINT AS block FROM b")
def budget_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.length("o_orderpriority").alias("bytes"))
    return sampling.budget_blocks(sizes, 4096).select("id", F.col("block").cast("long").alias("block"))


# -- more graphs and statistics -----------------------------------------------------------------------


@registered(f"WITH {EDGES} SELECT src, dst, round(distance, 6) AS distance FROM e JOIN v a ON src = a.vec_id JOIN v b ON dst = b.vec_id WHERE a.label = b.label")
def filter_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges between vectors of one label."""
    of = vectors(spark, sf_dir).select("id", "label")
    found = knn_edges(spark, sf_dir)
    keep = found.join(of.toDF("src", "a"), "src").join(of.toDF("dst", "b"), "dst").filter("a = b")
    return edges.filter_edges(found, keep).select("src", "dst", r("distance"))


@registered(f"WITH {EDGES}, n AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS no FROM v) SELECT a.label, a.no AS src, b.no AS dst, round(distance, 6) AS distance FROM e JOIN n a ON src = a.vec_id JOIN n b ON dst = b.vec_id WHERE a.label = b.label")
def subnetworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = vectors(spark, sf_dir).select(F.col("id").alias("node"), "label")
    return edges.subnetworks(knn_edges(spark, sf_dir), labels).select("label", "src", "dst", r("distance"))


@registered(f"WITH {EDGES} SELECT round(1.5 / greatest(2 * sum(distance), 1), 12) AS resolution FROM e")
def cpm_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.cpm_resolution(knn_edges(spark, sf_dir), 1.5, "distance").select(r("resolution", 12))


@registered(f"""
WITH RECURSIVE {EDGES}, walk AS (SELECT (SELECT min(vec_id) FROM v) AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN adj ON node = src WHERE depth < 12),
near AS (SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY 1)
SELECT min(node) AS node, depth FROM near WHERE depth = (SELECT max(depth) FROM near) GROUP BY 2
""")
def far_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = vectors(spark, sf_dir).agg(F.min("id")).first()[0]
    return traverse.far_end(knn_edges(spark, sf_dir), start)


@registered(f"WITH {VECTORS} SELECT a.vec_id AS id, b.vec_id AS other, round(list_distance(a.x, b.x), 6) AS distance FROM v a JOIN v b ON b.vec_id IN (3, 5, 8)")
def distances_to_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's distance to three of them."""
    v = vectors(spark, sf_dir)
    return neighbours.between(v, v.filter(F.col("id").isin(3, 5, 8)), 3).select("id", "other", r("distance"))


@registered(ORACLES["agreement_from_rate"])
def agreement_from_log_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`agreement_from_rate` with the prices given as logarithms, a large constant added."""
    scaled = stats.log_rate_to_counts(cells(spark, sf_dir).withColumn("log_price", F.log("price") + 900), ["row"], "value", "log_price")
    several = scaled.groupBy("row").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("a"), F.stddev_pop("predicted").alias("b")).filter("n >= 3 and a > 1e-9 and b > 1e-9")
    return stats.pearson_log1p(scaled.join(several.select("row"), "row"), ["row"], "value", "predicted").select("row", r("r", 5))


@registered("""
WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k FROM events),
h AS (SELECT min(n) // 2 AS half FROM (SELECT count(*) AS n FROM events GROUP BY event_type)),
g AS (SELECT event_type, k // half AS seg, half, avg(value) AS m, var_samp(value) AS v FROM e, h WHERE k // half < 2 GROUP BY 1, 2, 3),
b AS (SELECT half, avg(v) AS w, var_samp(m) AS b FROM g GROUP BY 1)
SELECT round(sqrt(((half - 1) / half * w + b) / w), 6) AS rhat FROM b
""")
def split_rhat_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the event types' values, as chains in time, agree."""
    return stats.split_rhat_chains(table(spark, sf_dir, "events"), [], "event_type", ["ts", "event_id"]).select(r("rhat"))


@registered(f"WITH {CELLS}, m AS (SELECT *, avg(price) OVER (PARTITION BY row) / 1e5 AS rate, avg(value) OVER (PARTITION BY col) AS mean FROM cells) SELECT row, col, round(2 * sqrt(greatest(value / greatest(rate * mean, 0.1), 0) + 0.375), 6) AS lite FROM m")
def anscombe_lite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = with_totals(with_totals(cells(spark, sf_dir), ["row"], rate=F.avg("price") / 1e5), ["col"], mean=F.avg("value"))
    return c.select("row", "col", r(norm.anscombe_lite(F.col("value"), F.col("rate"), F.col("mean")), 6, "lite"))


@registered("SELECT p_partkey, round(exp(least(v + 1, 5.0)), 6) AS grown, round((1 - (p_size % 2)) * -1e9, 1) + 0.0 AS pad, round(-0.5 * (v - 3) * (v - 3), 6) + 0.0 AS normal, round(-0.5 * (1 + v / 10 - v * v - exp(v / 10)), 6) + 0.0 AS kl, round(greatest(v, 0) * ln(p_size / 100.0 + 1e-8), 6) + 0.0 AS topic FROM (SELECT *, p_size - 25.0::DOUBLE AS v FROM part)")
def more_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("p_size") - 25.0
    return table(spark, sf_dir, "part").select(
        "p_partkey", r(norm.clamped_exp(v, 1.0, 5.0), 6, "grown"), r(norm.pad_score(F.col("p_size") % 2), 1, "pad"), r(likelihood.gaussian(v, F.lit(3.0)), 6, "normal"),
        r(likelihood.gaussian_kl(v, v / 10), 6, "kl"), r(likelihood.topic(v, F.col("p_size") / 100), 6, "topic"),
    )


@registered(f"WITH {RATES} SELECT row, round(2 * sum(x * ln(mu) - mu), 5) AS llik FROM t GROUP BY 1")
def joint_llik(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two modalities with equal likelihoods."""
    one = likelihood.summed(rates(spark, sf_dir), ["row"], likelihood.poisson(F.col("x"), F.col("mu")))
    return likelihood.joint(one, one, keys=["row"]).select("row", r("llik", 5))


# -- written and read again ---------------------------------------------------------------------------


def _file(spark: SparkSession, ending: str = "") -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}{ending}"


@registered(f"WITH {VECTORS} SELECT vec_id::VARCHAR AS row, round(list_sum(x), 4) + 0.0 AS total, len(x)::INTEGER AS width FROM v")
def matrix_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as compressed text with tabs, and read as a matrix."""
    path = _file(spark, ".tsv")
    sinks.write_delimited(matrix(spark, sf_dir), path)
    return tables.read_matrix(spark, path).select("row", r(norm.total(F.col("features")), 4, "total"), F.size("features").alias("width"))


@registered(f"WITH {VECTORS} SELECT vec_id::VARCHAR AS row, round(list_sum(x), 4) + 0.0 AS total, len(x)::INTEGER AS width FROM v")
def matrix_as_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, ".parquet")
    sinks.write_matrix(matrix(spark, sf_dir), path)
    return tables.read_matrix(spark, path).select("row", r(norm.total(F.col("features")), 4, "total"), F.size("features").alias("width"))


@registered(f"WITH {CELLS} SELECT row::BIGINT AS row, col::BIGINT AS col, round(value, 6) AS value FROM cells")
def matrix_market_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, ".mtx")
    c = cut_lineage(cells(spark, sf_dir).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value"))
    size = c.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    sinks.write_matrix_market(c, path, int(size["r"]) + 1, int(size["c"]) + 1)
    return tables.read_matrix_market(spark, path)[1].select("row", "col", r("value"))


@registered("SELECT n_name AS value FROM nation")
def lines_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, ".txt")
    sinks.write_lines(table(spark, sf_dir, "nation"), path, "n_name")
    return tables.text_lines(spark, path)


@registered("SELECT DISTINCT c_mktsegment AS name FROM customer")
def names_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, ".txt")
    sinks.write_lines(table(spark, sf_dir, "customer").select(F.concat_ws("\t", "c_mktsegment", F.col("c_custkey").cast("string")).alias("value")), path)
    return tables.read_name_list(spark, path)


@registered("SELECT coalesce(p_type, '') AS p_type FROM part")
def string_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_string_column(spark, f"{sf_dir}/part.parquet", "p_type")


@registered(f"WITH {EDGES} SELECT 'v' || src AS a, 'v' || dst AS b FROM e")
def edges_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, ".parquet")
    names = vectors(spark, sf_dir).select(F.col("id").alias("node"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("name"))
    sinks.write_edges(knn_edges(spark, sf_dir), names, path)
    return spark.read.parquet(path)


@registered("WITH p AS (SELECT n_name, r_name, r_regionkey + 100 AS b, n_nationkey AS a FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT a::BIGINT AS src, b::BIGINT AS dst FROM p")
def pairs_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of nations with their regions, resolved to numbers."""
    path = _file(spark, ".tsv")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    pairs = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    sinks.write_lines(pairs.select(F.concat_ws("\t", "n_name", "r_name").alias("value")), path)
    names = nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("node")).unionByName(region.select(F.col("r_name").alias("name"), (F.col("r_regionkey") + 100).cast("long").alias("node")))
    return edges.resolve_names(tables.read_pairs(spark, path), names).select("src", "dst")


@registered(ORACLES["column_running_stats_masked"].replace("l_suppkey, sum", "l_suppkey, sum").replace("round(sum(l_extendedprice), 2) AS tot", "round(sum(l_extendedprice), 2) AS tot"))
def stats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, ".parquet")
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    sinks.write_grouped_stats(stats.running_stats(lines, ["l_suppkey"], value="l_extendedprice"), path, ["l_suppkey"])
    return spark.read.parquet(path).select("l_suppkey", "nnz", r("tot", 2), r("mu", 4), r("sig", 2))


@registered("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS no, o_orderstatus AS row, o_custkey::DOUBLE AS customer, round(o_totalprice, 4) AS price FROM orders")
def lines_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of several files, whose names repeat, read again with their numbers."""
    path = _file(spark, ".tsv")
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("\t", "o_orderstatus", F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("string")).alias("value"))
    ordered.write_in_order(lines, path, F.col("o_orderkey"))
    rows, _ = ordered.read_delimited(spark, path, header=None)
    return rows.select("no", "row", F.get("features", F.lit(0)).alias("customer"), r(F.get("features", F.lit(1)), 4, "price"))


@registered("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::VARCHAR AS row, (o_custkey % 7)::DOUBLE AS a, (o_custkey % 2)::DOUBLE AS b FROM orders")
def rows_without_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of parquet files without row names, most of whose rows repeat."""
    path = _file(spark, ".parquet")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("a"), (F.col("o_custkey") % 2).alias("b"))
    sinks.write_table(orders.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select("a", "b"), path)
    return tables.read_matrix(spark, path).select("row", F.get("features", F.lit(0)).alias("a"), F.get("features", F.lit(1)).alias("b"))


@registered(f"WITH {CELLS} SELECT row, col AS \"column\", round((1 + value) / (1 + price / 1000), 6) AS mean, round(sqrt(1 + value) / (1 + price / 1000), 6) AS sd, 0.0::DOUBLE AS log_mean FROM cells")
def parameter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark, ".parquet")
    sinks.write_parameters(gamma.calibrate(posterior(spark, sf_dir), logs=False), path)
    return spark.read.parquet(path).select("row", "column", r("mean"), r("sd"), "log_mean")
