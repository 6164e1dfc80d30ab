"""Equal gains are a tie, in whatever order they are added."""

from gleanery.operators import evaluation


def test_equal_gains_in_another_order_tie(spark):
    for n in range(2, 11):
        run = spark.createDataFrame([(0, d, d + 1) for d in range(n)], "qid int, doc_id int, rank int")
        other = run.withColumn("rank", n + 1 - run["rank"])
        qrels = run.selectExpr("qid", "doc_id", "1 AS rel")
        got = evaluation.paired_bootstrap(evaluation.metrics(run, qrels), evaluation.metrics(other.repartition(3), qrels), "ndcg", 10).first()
        assert (got["wins"], got["losses"], got["ties"], got["gain"]) == (0, 0, 1, 0.0)
