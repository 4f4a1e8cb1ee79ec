import math

from pyspark.sql import functions as F

import lodestar.queries_small  # noqa: F401  registers its queries
from lodestar.functions import formats as fm
from lodestar.queries import QUERIES, SQL


def test_rounded_keeps_the_sign_of_zero_and_takes_halves_away_from_zero(spark):
    given = [-0.0000001, 0.0000001, 0.5, -0.5, 1.5, 2.5, -2.5, None, float("nan"), 0.1234565, 123.4567894]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x double")
    got = [r["six"] for r in rows.select("i", fm.rounded(F.col("x"), 6).alias("six")).orderBy("i").collect()]
    assert math.copysign(1, got[0]) == -1 and got[0] == 0 and math.copysign(1, got[1]) == 1
    assert got[7] is None and math.isnan(got[8]) and got[10] == 123.456789
    whole = [r["w"] for r in rows.filter("i between 2 and 6").select("i", fm.rounded(F.col("x"), 0).alias("w")).orderBy("i").collect()]
    assert whole == [1, -1, 2, 3, -3]


def test_vector_means_is_its_sql_to_the_sign_of_zero(spark, tmp_path):
    """Text tells the zeros apart, comparison doesn't."""
    import duckdb

    spark.createDataFrame([(1, [-1e-7, 0.25, 0.5]), (2, [-1e-7, 0.25, 1e-7]), (3, [1e-7, -0.25, 0.1])], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["vec_id"], str(r["mean"])) for r in QUERIES["vector_means"](spark, str(tmp_path)).collect())
    with duckdb.connect() as base:
        base.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        assert got == sorted((i, str(m)) for i, m in base.sql(SQL["vector_means"]).fetchall()) and "-0.0" in got[0][1]
