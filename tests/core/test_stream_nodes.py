"""Nodes from files that arrive in turn are those of all lines at once, and a query that starts again goes on."""

from pyspark.sql import functions as F

from cueline.functions.text import for_duplicates
from cueline.operators.quality import filter_lines
from cueline.streaming.nodes import ingest_nodes

SCHEMA = "line_id long, en_text string, word_count long"


def rows(spark):
    words = ["I really think we should go home now", "What are you doing here tonight", "She never told me about the money", "You have got to be kidding me"]
    texts = [[words[k * 7 % 4], words[k % 3].upper() + "!", words[0], f"I want {k // 2} more of these things please"][k % 4] for k in range(60)]
    made = [(k, t, len(t.split())) for k, t in enumerate(texts)] + [(100, None, 0), (None, words[0], 8), (101, "ok", 1)]
    return spark.createDataFrame(made, SCHEMA)


def test_three_batches_and_a_restart(spark, tmp_path):
    lines, path, checkpoint, seen = rows(spark), str(tmp_path / "lines"), str(tmp_path / "checkpoint"), {}
    passed = filter_lines(lines).where("filter_status = 'passed' AND line_id IS NOT NULL")
    want = {r.x: (r.node_id, r.n) for r in passed.groupBy(for_duplicates(F.col("en_text")).alias("x")).agg(F.min("line_id").alias("node_id"), F.count(F.lit(1)).alias("n")).collect()}
    assert len(want) > 5 and max(n for _, n in want.values()) > 10
    new, batches = [], []

    def sink(batch, number):
        batches.append(number)
        for r in batch.collect():
            seen[r.x] = (r.node_id, r.occurrence_count)
            new.extend([r.x] * r.is_new)

    # each part is another query, which goes on from the checkpoint
    for low, high in ((0, 20), (20, 45), (45, 1000)):
        lines.where(F.coalesce("line_id", F.lit(low)).between(low, high - 1)).repartition(2).write.mode("append").parquet(path)
        query = ingest_nodes(spark, path, SCHEMA, sink, checkpoint)
        query.awaitTermination(120)
        assert query.exception() is None
    assert seen == want
    assert sorted(new) == sorted(want), "each node is new once"
    assert batches == [0, 1, 2]
    ingest_nodes(spark, path, SCHEMA, sink, checkpoint).awaitTermination(60)
    assert seen == want and batches == [0, 1, 2], "nothing arrived"


def test_state_without_python(spark, tmp_path):
    """Texts and their state stay in the JVM: no call of Python for each text."""
    from cueline.streaming.nodes import stream_nodes

    lines = spark.readStream.schema(SCHEMA).parquet(str(tmp_path))
    plan = stream_nodes(lines)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and not any(word in plan for word in ("Python", "Pandas", "Arrow"))
