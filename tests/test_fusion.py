"""Dense ranking with more query vectors than are handed to every executor."""

from pyspark.sql import functions as F

from gleanery.operators import fusion


def test_any_number_of_query_vectors(spark, monkeypatch):
    rows = spark.range(60).select("id", (F.col("id") % 7).alias("label"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    asked = rows.where("id % 3 = 0").select(F.col("id").alias("qid"), F.col("v").alias("query_vector"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = fusion.cosine(rows, asked, "id", "label", "v").collect()
        monkeypatch.setattr(fusion, "MAX_QUERIES", 4)
        found = fusion.cosine(rows, asked, "id", "label", "v")
        assert sorted(found.collect()) == sorted(few) and len(few) == 60 * 20
        assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
