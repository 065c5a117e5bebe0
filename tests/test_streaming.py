from datetime import datetime, timedelta

from quillmesh.streaming.resume import new_documents, windowed_counts


def run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i % 6, start + timedelta(minutes=10 * i), "ab"[i % 2], float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, kind string, value double")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert sorted(r.id for r in run(new_documents(stream, "id", "ts"), "fresh", "append")) == list(range(6))
    got = {(r.start, r.kind): (r.n, r.total) for r in run(windowed_counts(stream, "ts", "kind"), "counts", "update")}
    assert sum(n for n, _ in got.values()) == 60 and got[(start, "a")] == (3, 0.0 + 2.0 + 4.0)
