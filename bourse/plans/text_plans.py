"""Registered text queries (SCA-9/10/11, AGG-5/6, MOD-7, UDF-2/3, SRC-5/6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourse.operators import text as TX
from bourse.plans.registry import register
from bourse.session import scratch_path
from bourse.sources import files as S
from bourse.sources import fixtures as X
from bourse.sources.fixtures import oracle_with as W
from bourse.sources.tables import table

KEYS = ["conv_id", "turn"]


def _tok_sql(col: str) -> str:
    return f"list_filter(string_split_regex(lower({col}), '[^a-z0-9]+'), lambda x: x <> '')"


def _ngram_sql(tok: str, n: int) -> str:
    if n == 1:
        return tok
    return f"list_transform(range(1, len({tok}) - {n - 2}), lambda i: array_to_string({tok}[i:i + {n - 1}], ' '))"


def _prf_sql(o: str, c: str, r: str) -> str:
    p = f"CASE WHEN {c} > 0 THEN CAST({o} AS DOUBLE) / {c} ELSE 0.0 END"
    rr = f"CASE WHEN {r} > 0 THEN CAST({o} AS DOUBLE) / {r} ELSE 0.0 END"
    f = f"CASE WHEN ({p}) + ({rr}) > 0 THEN 2 * ({p}) * ({rr}) / (({p}) + ({rr})) ELSE 0.0 END"
    return f"round({p}, 6) AS precision, round({rr}, 6) AS recall, round({f}, 6) AS f1"


def _rouge_sql(n: int) -> str:
    return (
        f"t{n} AS (SELECT conv_id, turn, {_ngram_sql(_tok_sql('reference_text'), n)} AS r, "
        f"{_ngram_sql(_tok_sql('candidate_text'), n)} AS c FROM pairs), "
        f"rg{n} AS (SELECT conv_id, turn, g AS gram, count(*) AS c_ref FROM (SELECT conv_id, turn, unnest(r) AS g "
        f"FROM t{n}) GROUP BY ALL), "
        f"cg{n} AS (SELECT conv_id, turn, g AS gram, count(*) AS c_cand FROM (SELECT conv_id, turn, unnest(c) AS g "
        f"FROM t{n}) GROUP BY ALL), "
        f"j{n} AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn, "
        "least(coalesce(c_ref, 0), coalesce(c_cand, 0)) AS o, coalesce(c_ref, 0) AS cr, coalesce(c_cand, 0) AS cc "
        f"FROM rg{n} a FULL JOIN cg{n} b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.gram = b.gram), "
        f"per{n} AS (SELECT conv_id, turn, sum(o) AS overlap, sum(cr) AS ref_n, sum(cc) AS cand_n FROM j{n} "
        "GROUP BY ALL), "
        f"out{n} AS (SELECT p.conv_id, p.turn, 'rouge{n}' AS metric, coalesce(overlap, 0) AS overlap, "
        "coalesce(ref_n, 0) AS ref_n, coalesce(cand_n, 0) AS cand_n FROM pairs p "
        f"LEFT JOIN per{n} q ON p.conv_id = q.conv_id AND p.turn = q.turn)")


@register("rouge_n", W(
    f"WITH {_rouge_sql(1)}, {_rouge_sql(2)} SELECT conv_id, turn, metric, overlap, ref_n, cand_n, "
    f"{_prf_sql('overlap', 'cand_n', 'ref_n')} FROM (SELECT * FROM out1 UNION ALL SELECT * FROM out2)", "pairs"))
def q_rouge_n(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-5: ROUGE-1 and ROUGE-2 of every (user, assistant) pair."""
    return TX.rouge_scores(X.pairs(spark, sf), KEYS, (1, 2))


@register("rouge_l")
def q_rouge_l(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-6: ROUGE-L (LCS) per pair; rows-only (checked against a DP in tests)."""
    return TX.rouge_l(X.pairs(spark, sf), KEYS)


@register("tokenize_words", W(f"SELECT conv_id, turn, {_tok_sql('reference_text')} AS tokens FROM pairs", "pairs"))
def q_tokenize_words(spark: SparkSession, sf: str) -> DataFrame:
    """SCA-11: ROUGE word tokens of the reference texts."""
    return X.pairs(spark, sf).select(*KEYS, TX.tokenize_words(F.col("reference_text")).alias("tokens"))


@register("task_prefix", W("SELECT doc_id, 'summarize: ' || text AS model_input FROM documents"))
def q_task_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """SCA-9 / UDF-3: task prefix as a built-in expression."""
    return table(spark, sf, "documents").select("doc_id", TX.task_prefix(F.col("text")).alias("model_input"))


@register("truncate_tokens", W(
    f"SELECT doc_id, len({_tok_sql(chr(39) + 'summarize: ' + chr(39) + ' || text')}) AS n_tokens, "
    f"len(({_tok_sql(chr(39) + 'summarize: ' + chr(39) + ' || text')})[1:512]) AS n_input, "
    f"({_tok_sql(chr(39) + 'summarize: ' + chr(39) + ' || text')})[1:512] AS input_tokens FROM documents"))
def q_truncate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """SCA-10: model input = first 512 word tokens of the prefixed whole text."""
    t = table(spark, sf, "documents").select(
        "doc_id", TX.tokenize_words(TX.task_prefix(F.col("text"))).alias("t"))
    cut = TX.truncate_tokens(F.col("t"), TX.MAX_INPUT_TOKENS)
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(cut).alias("n_input"), cut.alias("input_tokens"))


@register("truncate_targets", W(
    f"SELECT conv_id, turn, len({_tok_sql('reference_text')}) AS n_tokens, "
    f"({_tok_sql('reference_text')})[1:{TX.MAX_TARGET_TOKENS}] AS target_tokens FROM pairs", "pairs"))
def q_truncate_targets(spark: SparkSession, sf: str) -> DataFrame:
    """SCA-10: summary target = first 128 word tokens of the reference text."""
    t = X.pairs(spark, sf).select(*KEYS, TX.tokenize_words(F.col("reference_text")).alias("t"))
    return t.select(*KEYS, F.size("t").alias("n_tokens"),
                    TX.truncate_tokens(F.col("t"), TX.MAX_TARGET_TOKENS).alias("target_tokens"))


@register("map_batches", W(
    f"SELECT doc_id, CAST(len({_tok_sql('text')}) AS BIGINT) AS n_tokens, "
    f"CAST(len(list_distinct({_tok_sql('text')})) AS BIGINT) AS n_distinct FROM documents"))
def q_map_batches(spark: SparkSession, sf: str) -> DataFrame:
    """UDF-2: batched pandas function over whole texts (mapInPandas)."""
    return TX.map_batches(table(spark, sf, "documents"))


_UTOK = "list_filter(string_split_regex(lower(sentence), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_SUMMARY_SQL = (
    "WITH s0 AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', "
    "'\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS parts FROM documents), "
    "s AS (SELECT doc_id, i - 1 AS pos, parts[i] AS sentence FROM (SELECT doc_id, parts, "
    "unnest(range(1, len(parts) + 1)) AS i FROM s0)), "
    f"st AS (SELECT doc_id, pos, sentence, {_UTOK} AS tokens FROM s), "
    "tk AS (SELECT doc_id, pos, unnest(tokens) AS term FROM st), "
    "dfq AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, term FROM tk) GROUP BY term), "
    "nd AS (SELECT count(DISTINCT doc_id) AS n FROM documents), "
    "sc AS (SELECT tk.doc_id, tk.pos, round(avg(ln((nd.n + 1.0) / (dfq.df + 1.0))), 9) AS score "
    "FROM tk JOIN dfq ON tk.term = dfq.term, nd GROUP BY tk.doc_id, tk.pos), "
    "r AS (SELECT st.doc_id, st.pos, st.sentence, len(st.tokens) AS n_tok, "
    "row_number() OVER (PARTITION BY st.doc_id ORDER BY sc.score DESC NULLS LAST, st.pos) AS rk, "
    "sum(len(st.tokens)) OVER (PARTITION BY st.doc_id ORDER BY sc.score DESC NULLS LAST, st.pos "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum "
    "FROM st LEFT JOIN sc ON st.doc_id = sc.doc_id AND st.pos = sc.pos) "
    "SELECT doc_id, string_agg(sentence, ' ' ORDER BY pos) AS summary, sum(n_tok) AS summary_tokens, "
    f"count(*) AS summary_sentences FROM r WHERE cum <= {TX.SUMMARY_MAX_TOKENS} "
    f"OR cum - n_tok < {TX.SUMMARY_MIN_TOKENS} GROUP BY doc_id")


@register("extractive_summary", _SUMMARY_SQL)
def q_extractive_summary(spark: SparkSession, sf: str) -> DataFrame:
    """MOD-7: TF-IDF extractive summary of every whole document (55 to 80 words where sentences allow)."""
    return TX.extractive_summary(table(spark, sf, "documents"))


@register("scan_text_pairs", W("SELECT conv_id, turn, reference_text, candidate_text FROM pairs", "pairs"))
def q_scan_text_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-6: text/summary table landed as parquet, two text columns selected."""
    path = scratch_path(spark, "pairs-parquet")
    X.pairs(spark, sf).write.mode("overwrite").parquet(path)
    return S.scan_text_pairs(path, spark)


@register("scan_labelled_text", W("SELECT doc_id, text, label FROM sentences", "sentences"))
def q_scan_labelled_text(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-5: labelled sentences landed as quoted CSV and read back with a schema."""
    path = S.write_csv(X.sentences(spark, sf), scratch_path(spark, "sentences-csv"))
    return S.scan_labelled_text(spark, path)
