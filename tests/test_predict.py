"""Model stage: batches, isolation of failures, one model a worker, stable snippet ids."""

import os

from pyspark.sql import functions as F

from codeloom.operators.predict import predict
from codeloom.operators.scoring import llm_score
from codeloom.plans.workflow import ingest


def test_failures_stay_in_their_batch(spark):
    def factory():
        def model(prompts):
            if "bad" in prompts:
                raise RuntimeError("no")
            return [f" {p} 0.9 " for p in prompts]
        return model
    df = spark.createDataFrame([(i, "bad" if i == 5 else f"p{i}") for i in range(12)], "id long, p string").coalesce(1)
    rows = predict(df, "p", "reply", factory, batch_size=4, error="why").withColumn("s", llm_score(F.col("reply"))).orderBy("id").collect()
    assert [r.reply for r in rows[:4]] == ["p0 0.9", "p1 0.9", "p2 0.9", "p3 0.9"]
    assert all(r.reply is None and r.why == "RuntimeError: no" and r.s == 0.5 for r in rows[4:8])
    assert all(r.why is None and r.reply == f"p{r.id} 0.9" for r in rows[8:])


def test_one_model_a_worker(spark, scratch):
    def factory():
        import tempfile
        tempfile.mkstemp(dir=scratch, prefix=f"{os.getpid()}-")
        return lambda prompts: prompts
    df = spark.range(64).select(F.col("id").cast("string").alias("p")).repartition(16)
    for _ in range(2):
        assert predict(df, "p", "reply", factory).count() == 64
    made = [f.split("-")[0] for f in os.listdir(scratch)]
    assert len(made) == len(set(made))


def test_ids_do_not_depend_on_partitions(spark):
    src = [("s", f"m{i}.py", f"def f{i}(v):\n    return v  # note\n") for i in range(9)] + [("t", "m0.py", "def f0(v):\n    return v  # note\n")]
    df = spark.createDataFrame(src, "snapshot_id string, path string, content string")
    ids = [{(r.doc_id, r.snapshot_id, r.snippet_id) for r in ingest(df.repartition(n))["snippets"].collect()} for n in (1, 5)]
    assert ids[0] == ids[1] and len({x[0] for x in ids[0]}) == len(ids[0])
