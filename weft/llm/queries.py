"""The registered queries of the corpus operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, jaccard_join, language_id, license_scan, mixing, sharding, token_rollup, topk_search, toxicity
from .common import Stash, held_out

#: The tokenizer of the token counts: a vocabulary file on every node, and its split pattern.
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER_VERSION = "byte_bpe_50k"
#: Fixed value: the pattern that the vocabulary was made with.
TOKENIZER_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k_inner_product(_table(spark, sf_dir, "embeddings"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), held_out(F.col("doc_id")))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.array_join("words", ",").alias("restored_words"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "source", "copy", F.round("mean", 9).alias("mean"), "shuffle_key")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sharding.interleave(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs, held_out(F.col("doc_id")))
    return language_id.identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches and a replay: all documents arrive with their bytes as a first estimate, every count is then
    revised to the tokenizer's, and what has no text is deleted. The replayed batch must change nothing."""
    docs = _table(spark, sf_dir, "documents")
    stash = Stash(spark, "token-counts")
    counted = token_rollup.count_tokens(
        docs.withColumn("estimate", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")),
        f"{TOKENIZER_DIR}/{TOKENIZER_FILE}", TOKENIZER_PATTERN, keep=("doc_id", "source", "lang", "estimate"),
    )
    counted = stash.put("counts", counted).withColumn("tokenizer_version", F.lit(TOKENIZER_VERSION))
    rollup = token_rollup.TokenRollup(spark, f"{stash.root}/rollup")
    key = ["source", "lang", "tokenizer_version"]
    rollup.apply("0001-arrivals", counted.select(F.lit("insert").alias("op"), *key, F.col("estimate").alias("n_tokens")))
    revised = counted.select(F.lit("revise").alias("op"), *key, "n_tokens", F.col("estimate").alias("old_tokens"))
    rollup.apply("0002-recount", revised)
    rollup.apply("0002-recount", revised)
    rollup.apply("0003-empty", counted.where("estimate = 0").select(F.lit("delete").alias("op"), *key, "n_tokens"))
    return rollup.totals()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_topk_search, op2_decontamination, op3_toxicity, op4_ngram_jaccard_join, op5_license_scan,
        op6_html_extraction, op7_source_mixing, op8_sharding, op9_language_id, op10_token_counts,
    )
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words_sql(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP2 = f"""
WITH dw AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents),
bw AS (SELECT item_id, {_words_sql('text')} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + 9], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM bw WHERE len(w) > 0)
),
dwin AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
),
hits AS (SELECT DISTINCT d.doc_id, d.s, d.n, b.item_id FROM dwin d JOIN wins b USING (k, n)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def _op5_sql(gap: int = 1) -> str:
    known, compiled = license_scan.compile_rules(license_scan.RULES, gap)
    known = {s: i for s, i in known.items() if "*" not in s}  # a line with a variable part is no plain list entry
    table = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in known) + "]"
    numbers = "[" + ", ".join(map(str, known.values())) + "]"
    cases = []
    for licence, ids, pattern in compiled:
        line = "line"
        for other, longer, wider in compiled:
            if other != licence and len(longer) > len(ids) and longer[: len(ids)] == ids:
                line = f"regexp_replace({line}, '{wider}', '0000 ', 'g')"
        cases.append(f"CASE WHEN regexp_matches({line}, '(?:^| ){pattern}') THEN '{licence}' END")
    return f"""
WITH s AS (
  SELECT doc_id, list_filter(list_transform(
    string_split_regex(regexp_replace(coalesce(text, ''), '([.!?;:])\\s+', '\\1' || chr(10), 'g'), '[\\r\\n]+'),
    lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS s FROM documents
), i AS (
  SELECT doc_id, list_transform(s, lambda x: coalesce(list_extract({numbers}, list_position({table}, x)), 0)::INTEGER) AS ids FROM s
), l AS (
  SELECT doc_id, list_filter(ids, lambda x: x > 0) AS hit,
         array_to_string(list_transform(ids, lambda x: lpad(x::VARCHAR, 4, '0')), ' ') || ' ' AS line FROM i
)
SELECT doc_id, len(hit)::BIGINT AS n_sentences, coalesce(array_to_string(hit, ','), '') AS sentence_ids,
       CASE WHEN len(hit) > 0 THEN coalesce(array_to_string(list_sort(list_distinct(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL))), ','), '') ELSE '' END AS licences
FROM l
"""


_OP7 = """
WITH b AS (SELECT source, sum(coalesce(strlen(text), 0) + 1) AS bytes FROM documents GROUP BY source),
w AS (SELECT source, bytes, round(pow(bytes::DOUBLE, 0.7) * 1000) AS want FROM b),
m AS (SELECT source, want / (SELECT sum(want) FROM w) * (SELECT sum(bytes)::DOUBLE FROM w) / bytes AS mean FROM w),
k AS (
  SELECT source, mean, unnest(range(0, ceil(mean + 12 * sqrt(mean) + 40)::BIGINT + 1)) AS k FROM m
),
c AS (SELECT source, mean, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT doc_id, source, ('0x' || substr(md5('17:' || doc_id), 1, 13))::BIGINT / pow(2.0, 52) AS u FROM documents),
n AS (
  SELECT u.doc_id, u.source, any_value(c.mean) AS mean, count(*) FILTER (c.cdf <= u.u) AS n
  FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY u.doc_id, u.source
),
x AS (SELECT doc_id, source, mean, unnest(range(1, n + 1))::INTEGER AS copy FROM n)
SELECT doc_id, source, copy, round(mean, 9) AS mean, ('0x' || substr(md5('17:shuffle:' || doc_id || ':' || copy), 1, 15))::BIGINT AS shuffle_key FROM x
"""

ORACLES: dict[str, str] = {
    "op1_topk_search": _OP1,
    "op2_decontamination": _OP2,
    "op5_license_scan": _op5_sql(),
    "op7_source_mixing": _OP7,
}
