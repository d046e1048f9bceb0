from driftledger.streaming.feed import changes_of

SCHEMA = "path string, revision long, oid string"


def test_changes_of_a_stream(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        [("a", 1, "x"), ("b", 1, "y"), (None, 1, "z")],
        [("a", 2, "x"), ("b", 3, None), ("b", 2, "yy")],
        [("b", 4, "y"), ("a", 1, "old"), ("a", 5, "z")],
    ]
    got = []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(source)
        stream = changes_of(spark.readStream.schema(SCHEMA).parquet(source))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(sink).awaitTermination(120)
        seen = {tuple(r) for r in spark.read.parquet(sink).collect()}
        got.append(seen - set().union(*got))
    assert got == [
        {("a", 1, "A", None, "x"), ("b", 1, "A", None, "y")},
        {("b", 2, "M", "y", "yy"), ("b", 3, "D", "yy", None)},
        {("b", 4, "A", None, "y"), ("a", 5, "M", "x", "z")},
    ]
