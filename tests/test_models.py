"""Calls of a model: which prompts go into a call, how much is held."""

from quillstream.operators import models


def counts():
    """A model that answers each prompt with the number of prompts in its call."""

    class Counts:
        def answer(self, prompts):
            return ["short"] if prompts[0] == "p7" else [str(len(prompts))] * len(prompts)

    return Counts()


def test_calls_are_full_and_few_prompts_are_held(spark):
    rows = spark.range(60).selectExpr("id", "if(id % 2 = 0, null, concat('p', id)) as prompt", "array(id) as more").coalesce(1)
    got = {r["id"]: r["reply"] for r in models.ask(rows, "prompt", "reply", counts(), batch=3).collect()}
    assert [got[i] for i in (0, 1, 3, 5, 7, 9, 11, 13, 59)] == [None, "3", "3", "3", "short", None, None, "3", "3"]
    assert models.ask(rows, "prompt", "reply", counts()).columns == ["id", "prompt", "more", "reply"]
    assert models.ask(rows.limit(0), "prompt", "reply", counts()).count() == 0


def test_a_batch_is_read_in_slices():
    """The task's function over one large batch gives many small ones."""
    import pyarrow as pa
    from pyspark.sql import types as T

    class Rows:
        schema = T.StructType([T.StructField("prompt", T.StringType())])

        def mapInArrow(self, run, schema):
            return run

    run = models.ask(Rows(), "prompt", "reply", counts(), batch=5)
    out = list(run(iter([pa.RecordBatch.from_arrays([pa.array(["x", None] * 500)], names=["prompt"])])))
    assert sum(b.num_rows for b in out) == 1000 and max(b.num_rows for b in out) <= 2 * models.CALLS * 5
    assert {v for b in out for v in b.column(1).to_pylist()} == {"5", None}
