"""Queries of feature and descriptor matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linear import tidy
from ..operators import matching as M
from ..session import table
from .fixtures import with_
from .registry import register

RATIO = 0.95
PAIRS = """
e AS (SELECT label AS img_id, vec_id AS feat_id, embedding AS d FROM embeddings),
near AS (SELECT a.img_id AS img_a, b.img_id AS img_b, a.feat_id AS query_idx, b.feat_id AS train_idx, list_sum(list_transform(range(1, 65), lambda k: (a.d[k] - b.d[k])::DOUBLE * (a.d[k] - b.d[k])::DOUBLE)) AS d2 FROM e a JOIN e b ON a.img_id < b.img_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY img_a, img_b, query_idx ORDER BY d2, train_idx) AS rank FROM near),
two AS (SELECT img_a, img_b, query_idx, max(train_idx) FILTER (rank = 1) AS train_idx, sqrt(max(d2) FILTER (rank = 1)) AS d1, sqrt(max(d2) FILTER (rank = 2)) AS d2 FROM ranked WHERE rank <= 2 GROUP BY ALL HAVING count(*) = 2),
kept AS (SELECT * FROM two WHERE d1 < 0.95 * d2)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("img_id"), F.col("vec_id").alias("feat_id"), F.col("embedding").alias("desc"))


@register("m2_match_ratio_test", with_(PAIRS) + "SELECT img_a, img_b, count(*)::BIGINT AS num_matches, count(*)::BIGINT AS num_inliers, 1.0::DOUBLE AS inlier_ratio FROM kept GROUP BY ALL")
def match_ratio_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match_summary(M.ratio_test(M.nearest_two(features(spark, sf_dir)), RATIO))


@register("m1_nearest_descriptor", with_(PAIRS) + "SELECT img_a, img_b, query_idx, train_idx, round(d1, 4) + 0.0 AS d1 FROM two")
def nearest_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.nearest_two(features(spark, sf_dir)).select("img_a", "img_b", "query_idx", "train_idx", tidy(F.col("d1"), 4).alias("d1"))


@register("m3_pairs_with_enough_matches", with_(PAIRS) + "SELECT img_a, img_b, count(*)::BIGINT AS n FROM kept GROUP BY ALL HAVING count(*) >= 10")
def enough_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ratio_test(M.nearest_two(features(spark, sf_dir)), RATIO, 10).groupBy("img_a", "img_b").agg(F.count("*").alias("n"))


@register(
    "f2_strongest_features",
    "SELECT label AS img_id, vec_id AS feat_id, round(embedding[1]::DOUBLE, 5) + 0.0 AS response FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) <= 20",
)
def strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).withColumn("response", F.col("desc")[0])
    return M.strongest(f, 20).select("img_id", "feat_id", tidy(F.col("response").cast("double"), 5).alias("response"))


@register("f5_feature_counts", "SELECT label AS img_id, count(*)::BIGINT AS num_features FROM embeddings GROUP BY 1")
def feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).groupBy("img_id").agg(F.count("*").alias("num_features"))


@register(
    "m1_hamming_neighbours",
    """WITH f AS (SELECT label AS img_id, vec_id AS feat_id, list_transform(range(0, 2), lambda w: list_sum(list_transform(range(1, 33), lambda k: CASE WHEN embedding[w * 32 + k] > 0 THEN (1::BIGINT << (k - 1)) ELSE 0 END))::BIGINT) AS bits FROM embeddings)
SELECT a.img_id, a.feat_id, min(bit_count(xor(a.bits[1], b.bits[1])) + bit_count(xor(a.bits[2], b.bits[2])))::INT AS least FROM f a JOIN f b ON b.img_id = a.img_id + 1 GROUP BY ALL""",
)
def hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda w: F.expr(f"aggregate(sequence(0, 31), 0L, (s, k) -> s + CASE WHEN desc[{w} * 32 + k] > 0 THEN shiftleft(1L, k) ELSE 0L END)")
    f = features(spark, sf_dir).select("img_id", "feat_id", F.array(word(0), word(1)).alias("bits"))
    pairs = f.select(F.col("img_id").alias("img_a"), (F.col("img_id") + 1).alias("img_b")).distinct()
    return M.nearest_bits(f, pairs).select(F.col("img_a").cast(f.schema["img_id"].dataType).alias("img_id"), F.col("query_idx").alias("feat_id"), "least")
