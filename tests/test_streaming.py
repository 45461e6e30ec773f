from plurality.operators import inference as I
from plurality.operators.cache import CallCache
from plurality.streaming.resume import answer_stream


def test_jobs_are_answered_once(spark, tmp_path):
    columns = [*I.KEY, "text"]
    schema = ", ".join(f"{c} string" for c in columns)
    put = lambda ids: spark.createDataFrame([("e", "p", i, "v", "h", "m1", "s", "t") for i in ids], schema).write.mode("append").parquet(str(tmp_path / "jobs"))
    make = lambda: lambda text, variant: "{}"

    def run():
        jobs = spark.readStream.schema(schema).parquet(str(tmp_path / "jobs"))
        answer_stream(jobs, make, str(tmp_path / "cache"), str(tmp_path / "state")).awaitTermination(60)
        return sorted(r["item_id"] for r in CallCache(spark, str(tmp_path / "cache")).calls().collect())

    put(["1", "2", "2"])
    assert run() == ["1", "2"]
    put(["2", "3"])
    assert run() == ["1", "2", "3"]
