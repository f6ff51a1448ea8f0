"""Registered neighbour queries: JOI-5 `knn_candidates`, MOD-10 `knn_classifier`,
PRE-13 `smote_oversample`.

Spark runs the exact k-d tree search of ``operators/neighbours.py``; the
oracle SQL is the brute-force definition (every test row against every
training row, top k by distance then key) over the same prepared features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bourse.operators import neighbours as NB
from bourse.plans import profile_plans as PP
from bourse.plans.registry import register
from bourse.sources.fixtures import oracle_with as W

SEED = PP.SEED
K = 5
FEATS = PP._FEATURES


def _dist_sql(a: str, b: str) -> str:
    return "0.0 + " + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in FEATS)


_NN_SQL = (
    f"WITH {PP._PREP_SQL}, ptr AS (SELECT * FROM prep WHERE split = 'train'), "
    "pte AS (SELECT * FROM prep WHERE split = 'test'), "
    f"d AS (SELECT q.row_id, p.row_id AS neighbour, p.label AS n_label, {_dist_sql('q', 'p')} AS dist2 "
    "FROM pte q, ptr p), "
    f"nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist2, neighbour) AS nn "
    f"FROM d) WHERE nn <= {K})")


def _neighbours(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    prep, feats = PP._prepared(spark, sf)
    assert feats == FEATS, feats
    train = prep.where(F.col("split") == "train")
    test = prep.where(F.col("split") == "test")
    return NB.knn(test, train, "row_id", feats, K, payload=["label"], seed=SEED), test


@register("knn_candidates", W(f"{_NN_SQL} SELECT row_id, nn, neighbour, n_label, round(dist2, 6) AS dist2 FROM nn",
                              "tab"))
def q_knn_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """JOI-5: the 5 nearest training rows of every test row (exact, no all-pairs)."""
    nn, _ = _neighbours(spark, sf)
    return nn.select("row_id", "nn", "neighbour", "n_label", F.round("dist2", 6).alias("dist2"))


def _vote_sql(k: int) -> str:
    return (f"v{k} AS (SELECT row_id, arg_min(n_label, (-v, n_label)) AS pred_k{k} FROM (SELECT row_id, n_label, "
            f"count(*) AS v FROM nn WHERE nn <= {k} GROUP BY 1, 2) GROUP BY 1)")


@register("knn_classifier", W(
    f"{_NN_SQL}, {_vote_sql(3)}, {_vote_sql(5)} SELECT pte.row_id, pte.label, v3.pred_k3, v5.pred_k5 "
    "FROM pte JOIN v3 ON v3.row_id = pte.row_id JOIN v5 ON v5.row_id = pte.row_id", "tab"))
def q_knn_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """MOD-10: majority vote of the 3 and of the 5 nearest training rows."""
    nn, test = _neighbours(spark, sf)
    nn = nn.checkpoint(eager=True)  # read by both votes
    v3 = NB.knn_vote(nn, "row_id", "n_label", 3).withColumnRenamed("pred", "pred_k3")
    v5 = NB.knn_vote(nn, "row_id", "n_label", 5).withColumnRenamed("pred", "pred_k5")
    return test.select("row_id", "label").join(v3, "row_id").join(v5, "row_id")


_HEX6 = "CAST(('0x' || substr(md5({}), 1, 6)) AS BIGINT)"
_TAG = f"CAST(g.row_id AS VARCHAR) || '-{SEED}-' || CAST(g.i AS VARCHAR)"

_SMOTE_SQL = W(
    f"WITH {PP._PREP_SQL}, ptr AS (SELECT * FROM prep WHERE split = 'train'), "
    "cnt AS (SELECT label, count(*) AS c FROM ptr GROUP BY label), "
    "mi AS (SELECT arg_min(label, (c, label)) AS lab, min(c) AS m, max(c) - min(c) AS extra FROM cnt), "
    "mn AS (SELECT ptr.* FROM ptr, mi WHERE ptr.label = mi.lab), "
    f"rk AS (SELECT *, row_number() OVER (ORDER BY md5(concat(CAST(row_id AS VARCHAR), '{SEED}')), row_id) AS r "
    "FROM mn), "
    "ii AS (SELECT unnest(range(1, extra + 1)) AS i, m FROM mi), "
    "g AS (SELECT ii.i, ii.m, rk.* FROM ii JOIN rk ON rk.r = (ii.i - 1) % ii.m + 1), "
    f"nb AS (SELECT a.row_id AS base, b.row_id AS neighbour, {_dist_sql('a', 'b')} AS dist2, "
    + ", ".join(f"b.{c} AS n_{c}" for c in FEATS) + " FROM mn a, mn b WHERE a.row_id <> b.row_id), "
    "nr AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY dist2, neighbour) AS nn FROM nb), "
    f"gp AS (SELECT g.*, {_HEX6.format(_TAG + chr(32) + '|| ' + repr('n'))} % least({K}, g.m - 1) + 1 AS pick, "
    f"CAST({_HEX6.format(_TAG)} AS DOUBLE) / {float(16 ** 6)} AS u FROM g) "
    "SELECT gp.i, gp.row_id AS base, nr.neighbour, gp.label, "
    + ", ".join(f"round(gp.{c} + gp.u * (nr.n_{c} - gp.{c}), 6) AS {c}" for c in FEATS)
    + " FROM gp JOIN nr ON nr.base = gp.row_id AND nr.nn = gp.pick", "tab")


@register("smote_oversample", _SMOTE_SQL)
def q_smote_oversample(spark: SparkSession, sf: str) -> DataFrame:
    """PRE-13: synthetic minority rows between a row and one of its 5 nearest
    minority rows, until the training classes are balanced."""
    prep, feats = PP._prepared(spark, sf)
    train = prep.where(F.col("split") == "train").select("row_id", "label", *feats)
    s = NB.smote(train, "row_id", "label", feats, SEED, K)
    return s.select("i", "base", "neighbour", "label", *[F.round(c, 6).alias(c) for c in feats])
