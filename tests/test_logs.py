import pytest
from pyspark.sql import functions as F

from metrolex.sources import exports, logs, vocabulary
from metrolex.streaming import logs as stream


def _lines(spark):
    df = spark.createDataFrame([(1, "nowhere", '{"a": 1}'), (2, "api", None), (3, None, "{}")], "id long, cat string, ctx string")
    at = F.timestamp_seconds(F.col("id") * 60)
    first = logs.info(df, F.concat(F.lit("m"), F.col("id").cast("string")), F.lit("test"), at=at, file=F.lit("/x/y.py"), line=F.col("id"), category_col=F.col("cat"), context=F.col("ctx"))
    return first, logs.sent(first, F.col("line_number") == 1).where("line_number != 3")


def test_records_defaults_and_routing(spark):
    first, _ = _lines(spark)
    rows = {r["line_number"]: r for r in first.collect()}
    assert (rows[1]["category"], rows[2]["category"], rows[3]["category"]) == ("system", "api", "system")
    assert rows[2]["context"] == "{}" and rows[1]["event_type"] == "general" and rows[1]["file_name"] == "y.py" and rows[1]["local_log_file"] == "system.log"
    assert first.columns[:13] == [f.name for f in logs.SCHEMA.fields]


def test_json_lines_last_write_wins_batch_and_stream(spark, tmp_path):
    folder = str(tmp_path / "logs")
    first, second = _lines(spark)
    logs.create(spark, folder + "_empty")
    assert logs.read(spark, folder + "_empty").count() == 0
    logs.append(first, folder)
    logs.append(second, folder)
    lines = logs.read(spark, folder)
    assert lines.count() == 5
    latest = logs.latest(lines)
    assert {(r["line_number"], r["synced_to_appwrite"], r["log_id"] is None) for r in latest.collect()} == {(1, True, False), (2, False, False), (3, False, True)}
    assert logs.last_line(lines).first()["message"] == "m3"
    q = stream.latest_stream(stream.read_stream(spark, folder)).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    cols = [f.name for f in logs.SCHEMA.fields]
    assert sorted(map(str, spark.table("latest").select(cols).collect())) == sorted(map(str, latest.select(cols).collect()))


def test_table_refuses_nulls(spark):
    _, second = _lines(spark)
    spark.sql("drop table if exists sent_logs")
    logs.create_table(spark, "sent_logs")
    logs.create_table(spark, "sent_logs")
    logs.insert(second, "sent_logs")
    assert spark.table("sent_logs").count() == 2 and "sent_logs" in [r["name"] for r in logs.catalog(spark).collect()]
    with pytest.raises(ValueError):
        logs.insert(second.withColumn("log_id", F.lit(None).cast("string")), "sent_logs")
    spark.sql("drop table sent_logs")


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "x string, y int")
    for name in ("json", "csv", "xml"):
        exports.export(df, str(tmp_path / name), name)
    exports.export(df.select("x"), str(tmp_path / "txt"), "txt")
    assert spark.read.json(str(tmp_path / "json")).count() == spark.read.text(str(tmp_path / "txt")).count() == 2
    assert vocabulary.read_documents(spark, str(tmp_path / "xml")).count() == 2
    for name in ("json", "csv", "xml"):
        assert sorted(map(tuple, exports.read_export(spark, str(tmp_path / name), name, df.schema).collect())) == [("a", 1), ("b", 2)]
    for f in (exports.export, lambda d, *a: exports.read_export(spark, *a)):
        with pytest.raises(ValueError):
            f(df, str(tmp_path / "odt"), "odt")
    assert all((tmp_path / "w" / f).is_dir() for f in exports.FOLDERS if exports.ensure_workspace(spark, str(tmp_path / "w")))


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("entity_type\tord\tterm\tsection\nunit\t0\tK\ttemperature\nunit\t1\t\"\tquote\n")
    (tmp_path / "t.tsv").write_text("tpl_id\tfamily\ttext\n0\tbase\t{polymer}, {value}\n")
    assert [r["term"] for r in vocabulary.read_lexicon(spark, str(tmp_path / "l.tsv")).orderBy("ord").collect()] == ["K", '"']
    assert vocabulary.read_templates(spark, str(tmp_path / "t.tsv")).first()["text"] == "{polymer}, {value}"


def test_stream_counts_to_files(spark, tmp_path):
    folder = str(tmp_path / "logs")
    first, second = _lines(spark)
    logs.append(first, folder)
    logs.append(second, folder)
    lines = stream.read_stream(spark, folder)
    q = stream.level_counts(lines).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["level"], r["count"]) for r in spark.table("counts").collect()] == [("INFO", 5)]
    stream.run_available(lines.select("message", "level"), str(tmp_path / "out"), str(tmp_path / "cp"))
    stream.run_available(lines.select("message", "level"), str(tmp_path / "out"), str(tmp_path / "cp"))  # nothing new
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_levels_and_configuration(spark):
    df = spark.range(1)
    more = {"at": F.timestamp_seconds(F.lit(0)), "file": F.lit("a/b.py"), "line": F.lit(1)}
    made = [f(df, F.lit("m"), F.lit("s"), **more) for f in (logs.info, logs.debug, logs.warning, logs.critical)] + [logs.error(df, F.lit("m"), F.lit("s"), stack_trace=F.lit("t"), **more)]
    assert {m.first()["level"] for m in made} == set(logs.LEVELS)
    with pytest.raises(TypeError):
        logs.error(df, F.lit("m"), F.lit("s"), **more)
    assert exports.configuration(spark, "/w", bucket="b").where("name = 'bucket' and value = 'b'").count() == 1
