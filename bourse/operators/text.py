"""Text: tokens, ROUGE-1/2/L, extractive summaries, batched text functions.

ROUGE-n explodes every (order, side, n-gram) of a pair once and counts both
sides in one aggregate keyed by (pair, order, gram): fine-grained keys,
partial aggregation before every shuffle, no join of n-gram tables. ROUGE-L needs a
longest common subsequence per pair; that is a per-row computation done in
an Arrow-batched pandas UDF with a bit-parallel LCS (word-length bit vectors
as Python integers: O(len(a) * len(b) / 64) per pair, whole texts).

The extractive summary scores sentences by TF-IDF weight.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the text jobs.
TASK_PREFIX = "summarize: "
MAX_INPUT_TOKENS = 512
MAX_TARGET_TOKENS = 128
SUMMARY_MAX_TOKENS = 80
SUMMARY_MIN_TOKENS = 55
FREQUENT_TERMS = 8192     # at most so many terms go to every task
ASCII_TOKEN_SPLIT = "[^a-z0-9]+"
UNICODE_TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokenize_words(text: Column) -> Column:
    """SCA-11: lower-case, non-[a-z0-9] runs are separators, empty tokens dropped."""
    return F.filter(F.split(F.lower(text), ASCII_TOKEN_SPLIT), lambda x: x != "")


def tokenize_unicode(text: Column) -> Column:
    """Letters and digits of any script (the summary works on four languages)."""
    return F.filter(F.split(F.lower(text), UNICODE_TOKEN_SPLIT), lambda x: x != "")


def task_prefix(text: Column, prefix: str = TASK_PREFIX) -> Column:
    """SCA-9 / UDF-3: prefix as a built-in expression (no UDF)."""
    return F.concat(F.lit(prefix), text)


def truncate_tokens(tokens: Column, n: int) -> Column:
    """SCA-10: at most ``n`` tokens (model input limit)."""
    return F.slice(tokens, 1, n)


def ngrams(tokens: Column, n: int) -> Column:
    """Word n-grams joined by a blank; empty when fewer than n tokens.

    Built from n shifted slices zipped together, so the token array is
    evaluated n times per row, not once per n-gram (a lambda that slices the
    token expression would re-tokenize the text for every position).
    """
    if n == 1:
        return tokens
    count = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    shifted = [F.slice(tokens, k + 1, count) for k in range(n)]
    zipped = F.arrays_zip(*shifted)
    return F.transform(zipped, lambda z: F.concat_ws(" ", *[z[str(k)] for k in range(n)]))


def _prf(overlap: Column, cand: Column, ref: Column, digits: int) -> list[Column]:
    p = F.when(cand > 0, overlap / cand).otherwise(F.lit(0.0))
    r = F.when(ref > 0, overlap / ref).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return [F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(f, digits).alias("f1")]


def rouge_scores(pairs: DataFrame, keys: list[str], orders: tuple[int, ...] = (1, 2),
                 ref_col: str = "reference_text", cand_col: str = "candidate_text", digits: int = 6) -> DataFrame:
    """AGG-5: clipped n-gram overlap -> precision (/candidate), recall (/reference), F1.

    One pass: every (n, side, gram) of a pair is exploded once, one aggregate
    on (pair, n, gram) counts both sides (partial aggregation before the
    shuffle), a second sums the clipped overlap per (pair, n). No join.
    """
    t = pairs.select(*keys, tokenize_words(F.col(ref_col)).alias("r"), tokenize_words(F.col(cand_col)).alias("c"))
    grams = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(side).alias("side"), ngrams(F.col(col), n).alias("g"))
                      for n in orders for side, col in (("ref", "r"), ("cand", "c"))])
    e = t.select(*keys, F.explode(grams).alias("x")).select(*keys, "x.n", "x.side", F.explode("x.g").alias("gram"))
    per_gram = e.groupBy(*keys, "n", "gram").agg(
        F.count_if(F.col("side") == "ref").alias("c_ref"), F.count_if(F.col("side") == "cand").alias("c_cand"))
    per = per_gram.groupBy(*keys, "n").agg(
        F.sum(F.least("c_ref", "c_cand")).alias("overlap"), F.sum("c_ref").alias("ref_n"),
        F.sum("c_cand").alias("cand_n"))
    # pairs whose texts have no n-grams still get a (zero) row per order
    base = t.select(*keys, F.explode(F.array(*[F.lit(n) for n in orders])).alias("n"))
    out = base.join(per, [*keys, "n"], "left").fillna(0, ["overlap", "ref_n", "cand_n"])
    return out.select(*keys, F.concat(F.lit("rouge"), F.col("n").cast("string")).alias("metric"),
                      "overlap", "ref_n", "cand_n",
                      *_prf(F.col("overlap").cast("double"), F.col("cand_n"), F.col("ref_n"), digits))


def rouge_n(pairs: DataFrame, keys: list[str], n: int, ref_col: str = "reference_text",
            cand_col: str = "candidate_text", digits: int = 6) -> DataFrame:
    """AGG-5 for one order n."""
    return rouge_scores(pairs, keys, (n,), ref_col, cand_col, digits)


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence (bit-parallel, whole sequences).

    Bit i of V tracks row i of the DP table over ``a``; every token of ``b``
    updates all rows at once: V = (V + (V & M)) | (V & ~M), M = positions of
    the token in ``a``. The LCS length is the number of zero bits of V.
    """
    m = len(a)
    if m == 0 or len(b) == 0:
        return 0
    masks: dict = {}
    for i, t in enumerate(a):
        masks[t] = masks.get(t, 0) | (1 << i)
    full = (1 << m) - 1
    v = full
    for t in b:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return m - bin(v).count("1")


@F.pandas_udf(T.LongType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow-batched LCS length of two token arrays."""
    return pd.Series([lcs_length(list(x) if x is not None else [], list(y) if y is not None else [])
                      for x, y in zip(a, b)], dtype="int64")


def rouge_l(pairs: DataFrame, keys: list[str], ref_col: str = "reference_text",
            cand_col: str = "candidate_text", digits: int = 6) -> DataFrame:
    """AGG-6: LCS-based precision, recall, F1 over word tokens."""
    t = pairs.select(*keys, tokenize_words(F.col(ref_col)).alias("r"), tokenize_words(F.col(cand_col)).alias("c"))
    t = t.select(*keys, lcs_udf("r", "c").alias("lcs"), F.size("r").alias("ref_n"), F.size("c").alias("cand_n"))
    return t.select(*keys, F.lit("rougeL").alias("metric"), F.col("lcs").alias("overlap"), "ref_n", "cand_n",
                    *_prf(F.col("lcs").cast("double"), F.col("cand_n"), F.col("ref_n"), digits))


# ---------------------------------------------------------------- extractive summary
def sentence_parts(text: Column) -> Column:
    """Pieces between line ends and after . ! ? (followed by blanks), blank ones included."""
    return F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), "\n")


def sentences(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, pos, sentence); blank pieces have a place but no row."""
    pieces = docs.select(key, F.posexplode(sentence_parts(F.col(text_col))).alias("pos", "sentence"))
    return pieces.withColumn("sentence", F.trim("sentence")).where(F.col("sentence") != "")


def extractive_summary(docs: DataFrame, key: str = "doc_id", text_col: str = "text",
                       max_tokens: int = SUMMARY_MAX_TOKENS, min_tokens: int = SUMMARY_MIN_TOKENS) -> DataFrame:
    """MOD-7: best sentences by mean TF-IDF weight, in text order, within a word budget.

    weight(term) = ln((N + 1) / (df + 1)); sentence score = mean weight of its
    tokens (rounded to 9 digits so equal sentences tie exactly); rank by
    score, then position; keep while the running token count <= max_tokens, or
    while the summary before it is shorter than min_tokens: so the best sentence
    always stays, and a long sentence can end a summary beyond max_tokens. Returns doc_id, summary, tokens, sentences.
    """
    n_docs = docs.select(key).distinct().count()
    # Sentence breaks are token separators, so a document's terms are the
    # distinct tokens of its whole text: found inside the row (no shuffle of
    # (document, term) pairs); the counts aggregate partially before the shuffle.
    # Empty pieces go after the explode, in generated code; a filter on the array is not.
    def pieces(text: str) -> Column:
        return F.split(F.lower(F.col(text)), UNICODE_TOKEN_SPLIT)

    vocabulary = docs.select(F.explode(F.array_distinct(pieces(text_col))).alias("term")).where(F.col("term") != "") \
        .groupBy("term").agg(F.count(F.lit(1)).alias("df")).checkpoint(eager=True)
    weight = F.log((F.lit(n_docs + 1.0)) / (F.col("df") + 1.0)).alias("w")
    # The FREQUENT_TERMS most frequent terms go to every task: a bounded table, and
    # no task gets a common term's rows. Their tokens become one sum a sentence
    # before anything is shuffled; only rare terms are joined by term.
    common = F.broadcast(vocabulary.orderBy(F.col("df").desc(), "term").limit(FREQUENT_TERMS).select("term", weight))
    toks = sentences(docs, key, text_col).select(key, "pos", F.explode(pieces("sentence")).alias("term")) \
        .withColumn("term", F.nullif("term", F.lit("")))           # a sentence without a word keeps a row
    rare = F.when(F.col("w").isNull(), F.col("term")).alias("rare")
    parts = toks.join(common, "term", "left").groupBy(key, "pos", rare).agg(
        F.sum("w").alias("w"), F.count("term").alias("n")).checkpoint(eager=True)
    joined = parts.where(F.col("rare").isNotNull()).select(key, "pos", "n", F.col("rare").alias("term")).join(
        vocabulary.select("term", weight), "term").select(key, "pos", (F.col("n") * F.col("w")).alias("w"), "n")
    s = parts.where(F.col("rare").isNull()).select(key, "pos", "w", "n").unionByName(joined).groupBy(key, "pos").agg(
        F.sum("w").alias("w"), F.sum("n").alias("n_tok"))
    s = s.select(key, "pos", "n_tok", F.round(F.try_divide("w", "n_tok"), 9).alias("score"))
    w = Window.partitionBy(key).orderBy(F.col("score").desc_nulls_last(), F.col("pos"))
    ranked = s.withColumn("cum", F.sum("n_tok").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kept = ranked.where((F.col("cum") <= max_tokens) | (F.col("cum") - F.col("n_tok") < min_tokens))
    out = kept.groupBy(key).agg(F.sort_array(F.collect_list("pos")).alias("_at"), F.sum("n_tok").alias("summary_tokens"),
                                F.count(F.lit(1)).alias("summary_sentences"))
    # numbers so far: the texts meet the places of their chosen sentences once
    chosen = F.transform("_at", lambda p: F.trim(F.get(F.col("_parts"), p)))
    return docs.select(key, sentence_parts(F.col(text_col)).alias("_parts")).join(out, key).select(
        key, F.array_join(chosen, " ").alias("summary"), "summary_tokens", "summary_sentences")


# ---------------------------------------------------------------- batched table function
def token_stats_batches(batches):
    """UDF-2 body: per Arrow batch, whole-text token statistics with pandas."""
    for pdf in batches:
        toks = pdf["text"].fillna("").str.lower().str.split(ASCII_TOKEN_SPLIT, regex=True)
        toks = toks.map(lambda xs: [x for x in xs if x])
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": toks.map(len).astype("int64"),
                            "n_distinct": toks.map(lambda xs: len(set(xs))).astype("int64")})


def map_batches(docs: DataFrame) -> DataFrame:
    """UDF-2: batched table function over text (``mapInPandas``, Arrow transfer)."""
    return docs.select("doc_id", "text").mapInPandas(
        token_stats_batches, "doc_id long, n_tokens long, n_distinct long")
