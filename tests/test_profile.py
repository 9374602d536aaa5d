from pyspark.sql import functions as F

from dwellspark.operators.profile import DISTINCT_ERROR, RANK_ERROR, merged_profile, profile_files


def test_merged_sketches_are_within_their_bounds(spark, tmp_path):
    rows = spark.range(60_000).select(
        (F.pmod(F.hash("id"), F.lit(20_000))).alias("a"), F.when(F.col("id") % 4 > 0, F.pow(F.lit(1.0001), F.col("id"))).alias("b"),
        F.concat(F.lit("x"), (F.col("id") % 700).cast("string")).alias("c"), F.lit(None).cast("int").alias("d"),
    )
    rows.repartition(7).write.parquet(f"{tmp_path}/one")
    rows.where("id % 3 = 0").withColumn("a", F.col("a") + 50_000).repartition(2).write.parquet(f"{tmp_path}/two")
    one, two = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("one", "two"))
    profiles = profile_files(one, ["a", "b", "c", "d"]).unionByName(profile_files(two, ["a", "b", "c", "d"]))
    assert profiles.count() == 9 * 4
    both, found = one.unionByName(two), {r.column: r for r in merged_profile(profiles, [0.1, 0.5, 0.9]).collect()}
    for name in "abcd":
        exact = both.agg(F.count(F.lit(1)), F.count_if(F.col(name).isNull()), F.countDistinct(name)).first()
        got = found[name]
        assert (got.rows, got.nulls) == exact[:2] and abs(got.distinct - exact[2]) <= 4 * DISTINCT_ERROR * exact[2]
        for rank, value in zip([0.1, 0.5, 0.9], got.quantiles or []):
            low, high = both.where(F.col(name).isNotNull()).agg(F.avg((F.col(name) < value).cast("int")), F.avg((F.col(name) <= value).cast("int"))).first()
            assert low - RANK_ERROR <= rank <= high + RANK_ERROR, (name, rank)
    assert found["c"].quantiles is None and found["d"].quantiles is None and found["a"].quantiles
