from tracewright.streaming import ingest


def test_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.json").write_text('{"prefix": {"ex": "http://e/"}, "entity": {"ex:e%d": {}}}' % i)
    for _ in range(2):  # a second run finds nothing new
        ingest.ingest(ingest.documents(spark, str(folder)), f"file://{tmp_path}/out", f"file://{tmp_path}/check", "json", once=True).awaitTermination()
    assert sorted(r.id.uri for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["http://e/e0", "http://e/e1", "http://e/e2"]
