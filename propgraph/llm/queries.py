"""Queries of this package's operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, mixing, pii, quality_rules, rule_ensemble, sharding, simhash, token_counts, toxicity
from .common import held_out, read, shared_folder

try:
    import public_tokenizers
except ImportError:  # the rank file's place is a parameter of the operator; only the query needs this
    public_tokenizers = None

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    if public_tokenizers is None:
        raise FileNotFoundError(name)
    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents"), tokenizer_path(RANKS), ids=False)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(read(spark, sf_dir, "documents"), shards=24, map_path=f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents")).drop("broken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    rows = toxicity.score(docs, net)
    return rows.select("doc_id", held_out(F.col("doc_id"), toxicity.FOLDS, toxicity.FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = rule_ensemble.fit(docs, read(spark, sf_dir, "labels"))
    rows = rule_ensemble.score(docs, model)
    return rows.select("doc_id", held_out(F.col("doc_id"), rule_ensemble.FOLDS, rule_ensemble.FOLD).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pii.replace(docs, spans="found")
    return rows.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), F.array_sort(F.array_distinct("found.kind")).alias("kinds"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit() and callable(v)}
    return dict(sorted(own.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_WORD = "'[^\\x20\\x09-\\x0D]+'"

OP3_SQL = f"""
WITH w AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD}))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM w GROUP BY 1),
n AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM n),
v AS (SELECT *, (total - coalesce(sum(cap) OVER before, 0)) / (weights - coalesce(sum(weight) OVER before, 0)) AS stand FROM r WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(stand, ratio) AS stand FROM v WHERE stand <= ratio),
g AS (SELECT source, source_size, least(cap, coalesce(l.stand * weight, cap)) AS target, ('0x' || substr(md5('1:' || coalesce('s' || source, 'n')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM r LEFT JOIN l ON true),
k AS (SELECT *, CASE WHEN size < 16 THEN size ELSE length(bin(size)) * 8 + size // (1 << (length(bin(size)) - 4)) - 8 END AS kind FROM w),
p AS (SELECT k.*, row_number() OVER (PARTITION BY source ORDER BY kind DESC, digest, doc_id NULLS FIRST, size) AS place FROM k),
c AS (SELECT p.doc_id, p.size, g.source_size, g.target, (floor(place * (target / source_size) + u) - floor((place - 1) * (target / source_size) + u))::INTEGER AS copies FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c
"""


def _op4_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
    known = {"mean_word_chars": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "stop_word_ratio": ("n_stop", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "ellipsis_line_ratio": ("n_dots", "n_lines")}
    tests = []
    for _, x, side, limit in quality_rules.RULES:
        value = "CASE WHEN {1} > 0 THEN {0} / {1} ELSE 0 END".format(*known[x]) if x in known else x
        tests.append(f"NOT ({value}) {'<' if side == 'min' else '>'} {limit}")
    return f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, {_WORD}) AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines FROM t),
i AS (SELECT row, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS win FROM (SELECT row, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
d AS (SELECT row, i FROM (SELECT *, count(*) OVER (PARTITION BY row, win) AS n FROM i) WHERE n > 1),
c AS (SELECT row, count(DISTINCT i + j) AS n FROM d CROSS JOIN range(8) AS g(j) GROUP BY 1),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(lines) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop, len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS n_dots FROM w LEFT JOIN c USING (row)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept FROM f
"""


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS z FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.z = l.a),
c AS (SELECT a AS vec_id, min(z) AS component_id FROM r GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express on whole tables."""
    return {"op3_mixing": OP3_SQL, "op4_quality_rules": _op4_sql(), "op9_embedding_dedup": OP9_SQL}
