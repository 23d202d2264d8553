"""A pipeline fitted in batch scores a file stream with the same results."""

from pyspark.ml import Pipeline

from conftest import SF_SMALL
from tessera.operators import features, models
from tessera.plans.training import gems_parts, gems_stages
from tessera.session import scratch_path
from tessera.streaming import start_scoring


def test_stream_scoring_equals_batch(spark):
    parts = gems_parts(spark, SF_SMALL)
    model = Pipeline(stages=[*gems_stages(), models.regressor("linear")]).fit(parts["train"])
    src = scratch_path(spark, "stream-src")
    parts["test"].write.parquet(src)
    stream = spark.readStream.schema(parts["test"].schema).parquet(src)
    sink = scratch_path(spark, "stream-sink")
    q = start_scoring(model, stream, sink, scratch_path(spark, "stream-checkpoint"), keep=["id", "prediction"])
    q.processAllAvailable()
    q.stop()
    got = {r.id: r.prediction for r in spark.read.parquet(sink).collect()}
    want = {r.id: r.prediction for r in model.transform(parts["test"]).select("id", "prediction").collect()}
    assert got == want and len(got) > 0
    assert features.vector_size(model.transform(parts["test"]), "features") == 6
