"""Tag counts on a stream equal those on a table."""

from datetime import datetime, timedelta

from vecloom.streaming.profile import tag_counts


def test_stream_as_table(spark, tmp_path):
    at = datetime(2023, 1, 1)
    rows = [(" noun" if i % 3 else "NOUN", f"w{i % 4}", at + timedelta(minutes=10 * i)) for i in range(30)] + [(None, "x", at), ("VERB", "v", None)]
    df = spark.createDataFrame(rows, "pos string, word_norm string, loaded_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = tag_counts(stream).writeStream.outputMode("complete").format("memory").queryName("tags").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("tags").collect()))
    assert got == sorted(map(tuple, tag_counts(df).collect())) and sum(r[3] for r in got) == 30
