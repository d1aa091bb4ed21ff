from datetime import datetime

from corvine.streaming.append import append_chunks, windowed_counts


def test_each_document_is_chunked_once(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "# A\ntext"), (2, None)], schema).coalesce(1).write.parquet(source)
    for _ in range(2):
        append_chunks(spark.readStream.schema(schema).parquet(source), target, f"{tmp_path}/cp").awaitTermination(60)
    assert sorted(r.doc_id for r in spark.read.parquet(target).collect()) == [1, 2]
    spark.createDataFrame([(3, "more")], schema).coalesce(1).write.mode("append").parquet(source)
    append_chunks(spark.readStream.schema(schema).parquet(source), target, f"{tmp_path}/cp").awaitTermination(60)
    assert sorted(r.doc_id for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_windowed_counts_as_a_batch(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 10, 5), "a", 1.0), (datetime(2024, 1, 1, 10, 55), "a", 2.0), (datetime(2024, 1, 1, 11, 0), "a", 4.0)], "ts timestamp, event_type string, value double")
    got = sorted((r.window_start.hour, r.event_type, r.events, r.total) for r in windowed_counts(rows).collect())
    assert got == [(10, "a", 2, 3.0), (11, "a", 1, 4.0)]
