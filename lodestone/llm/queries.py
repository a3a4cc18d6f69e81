"""The registered queries of this subpackage: one for each operator, over its whole table.

Each derives its columns from what its operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, fingerprints, hard_negatives, language_id, line_dedup, mixing, near_dedup, pii, quality_rules, secret_scan, substring_dedup, token_counts, vector_codes
from .spans import written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _of(spans: str, kinds) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir))
    counts = [F.size(_of("found", [k])).cast("long").alias(f"n_{k}") for k in (*secret_scan.BASE, "entropy")]
    return found.select("doc_id", *counts, F.sha2(written(_of("found", secret_scan.BASE)), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = """
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(concat_ws(':', doc_id::VARCHAR, md5(coalesce(text, '')))) AS place
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM docs GROUP BY source
), weighed AS (SELECT *, (no % 3 + 1)::DOUBLE AS weight, 3 * source_size AS most FROM sizes
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(most) OVER w, 0)::BIGINT) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY most / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), open AS (SELECT level FROM levels WHERE level * weight <= most ORDER BY most / weight, no LIMIT 1
), targets AS (
  SELECT source, source_size, no, least(most::DOUBLE, (SELECT level FROM open) * weight) AS target FROM levels
), queued AS (
  SELECT d.doc_id, d.place, d.size, t.source_size, t.no, t.target,
         (sum(d.size) OVER (PARTITION BY t.no ORDER BY d.place, d.doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS words
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, (words + epoch * source_size) / target AS finish FROM queued, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0 AND target > 0
), summed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, no, epoch, place ROWS UNBOUNDED PRECEDING) AS so_far FROM copies
), times AS (
  SELECT no, place, doc_id, count(*) AS n FROM summed WHERE so_far <= (SELECT sum(size) FROM docs) GROUP BY ALL
)
SELECT doc_id, size, source_size, target, size * coalesce(n, 0) AS taken FROM queued LEFT JOIN times USING (no, place, doc_id)
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(documents(spark, sf_dir))
    places = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cut.select("doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), chars.alias("removed_chars"), places.alias("removed_spans"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir).select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "ratio", "odd_chunks")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digests(bpe_codec.encode_decode(documents(spark, sf_dir)))


def codec_digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(documents(spark, sf_dir))
    counts = [F.size(_of("found", [k])).cast("long").alias(f"n_{k}") for k in (*pii.BASE, *pii.MORE)]
    score = F.array_max(F.transform("found", lambda s: s["score"])).alias("best_score")
    return found.select("doc_id", *counts, F.sha2(written(_of("found", pii.BASE)), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), score)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, least=20, min_docs=3))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (top IS NOT NULL AND doc_id <> top) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (top IS NULL OR doc_id = top), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (key) GROUP BY doc_id
"""


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), size=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP10_SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM worded
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n_a, b.n AS n_b, count(*) AS met
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY ALL
), links AS (SELECT a, b FROM shared WHERE 100 * met >= 80 * (n_a + n_b - met)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(embeddings(spark, sf_dir).withColumn("label", label))


OP11_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 10
"""


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(held, F.lit(False)))
    model = language_id.fit(docs.filter(~F.col("held_out")), ident="doc_id", text="text", lang="lang")
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encode(embeddings(spark, sf_dir))
    digits = F.array_join(F.regexp_extract_all(F.lower(F.hex("code")), F.lit("(..)")), "")
    coded = vector_codes.with_label_error(coded)
    return coded.select("vec_id", digits.alias("code"), "error", "label_error", F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"))


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds written out one after the other."""
    found = """
dist{r} AS MATERIALIZED (
  SELECT vec_id, p, k, sum((x.v - b.v) * (x.v - b.v)) AS d FROM numbers x JOIN book{r} b USING (p, d0) GROUP BY vec_id, p, k
), at{r} AS MATERIALIZED (SELECT vec_id, p, arg_min(k, (d, k)) AS k, min(d) AS d FROM dist{r} GROUP BY vec_id, p)"""
    moved = """, book{s} AS MATERIALIZED (
  SELECT b.p, b.k, b.d0, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN (
    SELECT p, k, d0, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS v FROM numbers JOIN at{r} USING (vec_id, p) GROUP BY p, k, d0
  ) m USING (p, k, d0)
),"""
    steps = "".join(found.format(r=r) + moved.format(r=r, s=r + 1) for r in range(rounds)) + found.format(r=rounds)
    return f"""
WITH kept AS (
  SELECT * FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), numbers AS MATERIALIZED (
  SELECT vec_id, i * {parts} // len(embedding) AS p, i % (len(embedding) // {parts}) AS d0, floor(4096 * embedding[i + 1]::DOUBLE)::BIGINT AS v
  FROM (SELECT *, unnest(range(len(embedding))) AS i FROM kept)
), firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT {entries}
), book0 AS MATERIALIZED (SELECT p, k, d0, v FROM numbers JOIN firsts USING (vec_id)), {steps}
, coded AS (
  SELECT vec_id, string_agg(printf('%02x', k::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM at{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY p, k, d0)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_source_mix": op2_source_mix,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_bpe_codec": op6_bpe_codec,
    "op7_personal_data": op7_personal_data,
    "op8_fingerprints": op8_fingerprints,
    "op9_line_dedup": op9_line_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_language_id": op12_language_id,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES: dict[str, str] = {"op2_source_mix": OP2_SQL, "op9_line_dedup": OP9_SQL, "op10_near_dedup": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_vector_codes": _op13_sql()}
