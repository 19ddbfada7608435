import json

from lexiforge.plans import pipeline
from lexiforge.streaming import keywords as streams


def test_pipeline_from_bytes_to_files(spark, tmp_path):
    csv = b"Search Keyword ,SV,Country,Other\nGaming-Laptop,10,US,x\ngaming laptop,20,US,x\ngaming laptops,5,,x\n,1,US,x\nusb stick,7,DE,x\n"
    entities = spark.createDataFrame([("brand", 1, "Laptop Co"), ("category", 1, "Gaming")], "kind string, ord long, entity string")
    config = pipeline.with_stage(pipeline.PipelineConfig(volume=True), "mark", lambda d: d.withColumn("marked", d.row_id >= 0))
    r = pipeline.run(spark, csv, "k.csv", entities=entities, config=config, output=str(tmp_path / "out"))
    rows = {x.original_keyword: x for x in r.data.collect()}
    assert r.keyword_column[1] == "ALIAS" and r.left_out == ["other"] and len(rows) == 4
    assert rows["usb stick"].normalized_keyword == "usb flash drive" and rows["usb stick"].status == "ACTIVE" and rows["usb stick"].reason is None
    assert sorted(x.status for x in rows.values()) == ["ACTIVE", "ACTIVE", "DUPLICATE", "DUPLICATE"]
    assert rows["gaming laptop"].category == "Gaming" and rows["gaming laptop"].search_volume > 0 and rows["gaming laptop"].marked
    assert json.loads((tmp_path / "out/summary.json").read_text())["summary"]["duplicates"] == 2 and len(r.files) == 3


def test_streams_count_and_drop_repeats(spark, tmp_path):
    rows = [("a", "2024-01-01 00:10:00", 1), ("a", "2024-01-01 00:20:00", 1), ("b", "2024-01-01 01:10:00", 2)]
    spark.createDataFrame(rows, "keyword string, t string, id long").selectExpr("keyword", "cast(t as timestamp) t", "id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("keyword string, t timestamp, id long").parquet(str(tmp_path / "in"))

    def collect(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    counts = collect(streams.window_counts(streams.normalised_stream(stream), "t", "normalized_keyword"), "counts", "complete")
    assert sorted((r.normalized_keyword, r.n) for r in counts) == [("a", 2), ("b", 1)]
    assert len(collect(streams.first_seen(stream, "t", ["id"]), "firsts", "append")) == 2
