import random

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_language_stage_rests_on_the_classifier(spark):
    """Random letters and a script that was not learned go; documents of the languages stay; all stay if nothing was learned."""
    r = random.Random(8)
    noise = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(80)) for _ in range(5)] + ["\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440 " * 20]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("text rlike '[a-z]'")
    odd = spark.createDataFrame([(10**9 + k, t, None) for k, t in enumerate([*noise, None, "12"])], docs.schema)
    got = {x.doc_id for x in corpus_pipeline.language(spark, docs.unionByName(odd), SF).collect()}
    n = docs.count()
    assert not any(k >= 10**9 for k in got) and len(got) > 0.99 * n
    unlabelled = docs.limit(20).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unlabelled, SF).count() == 20
