"""Streams of the event log: missing second lines, insertion once for each batch, contexts of any kind."""

import json
import os

import pytest
from pyspark.sql import functions as F

from metrolex.sources import logs
from metrolex.streaming import logs as stream

COLUMNS = [f.name for f in logs.SCHEMA.fields]


def _line(i, second=False, ok=True, **more):
    row = {"timestamp": f"2024-01-01T{i // 60:02d}:{i % 60:02d}:00.000000Z", "level": "INFO", "message": f"m{i}", "source": "t", "event_type": "general", "user_action": False, "context": "{}", "stack_trace": "", "file_name": "a.py", "line_number": i, "local_log_file": "system.log", "synced_to_appwrite": second and ok, "log_id": f"id{i}" if second else None}
    return row | more


def _write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.writelines(json.dumps(x) + "\n" for x in lines)


def test_missing_second_lines_are_told_once(spark, tmp_path):
    """Late, out-of-order, repeated and missing lines, a file and a run at a time with one checkpoint."""
    folder, out, check = (str(tmp_path / x) for x in ("logs", "out", "check"))
    files = [
        [_line(i) for i in range(10)] + [_line(i, True) for i in range(5)],
        [_line(i) for i in range(10, 41)] + [_line(5, True), _line(45, True)] + [_line(12)] * 3,  # 5 comes late enough, 45 before its first line
        [_line(i) for i in range(41, 61)] + [_line(20, True), _line(35, True), _line(45)],  # 20 comes when the watermark (30) has passed it
        [_line(i, True, False) for i in range(52, 61)],
    ]
    for n, lines in enumerate(files):
        _write(folder, f"f{n}", lines)
        stream.run_available(stream.unsent_stream(stream.read_stream(spark, folder), stream.read_stream(spark, folder)), out, check)
    every = logs.read(spark, folder)
    _write(folder, "end", [r.asDict() for r in stream.closing_lines(every).collect()])
    stream.run_available(stream.unsent_stream(stream.read_stream(spark, folder), stream.read_stream(spark, folder)), out, check)
    got = sorted(r["line_number"] for r in spark.read.parquet(out).collect())
    second = {0, 1, 2, 3, 4, 5, 45, 35, *range(52, 61)}  # without 20
    assert got == [i for i in range(61) if i not in second]
    batch = logs.latest(every).where("log_id is null and source != 'closing'")
    assert sorted(r["line_number"] for r in batch.collect()) == [i for i in got if i != 20]


def test_closing_line_of_an_empty_log(spark):
    assert stream.closing_lines(spark.createDataFrame([], logs.SCHEMA)).count() == 0


def test_batches_are_inserted_once(spark, tmp_path):
    folder, path, check = (str(tmp_path / x) for x in ("logs", "table", "check"))
    run = lambda: stream.insert_stream(stream.read_stream(spark, folder).where("log_id is not null"), path, check)
    rows = lambda: sorted(r["line_number"] for r in stream.read_inserted(spark, path).collect())
    assert rows() == []
    _write(folder, "a", [_line(i, True) for i in range(20)] + [_line(3)])
    run()
    assert rows() == list(range(20))
    os.remove(f"{check}/commits/0")  # as if the driver died after the write: the batch is played again
    if os.path.exists(f"{check}/commits/.0.crc"):
        os.remove(f"{check}/commits/.0.crc")
    run()
    assert rows() == list(range(20)) and {r["batch"] for r in stream.read_inserted(spark, path).collect()} == {0}
    spark.range(5).selectExpr("'half' as message").write.parquet(f"{path}/rows/batch=1")  # a batch that broke off before its entry
    assert rows() == list(range(20))
    _write(folder, "b", [_line(i, True) for i in range(20, 30)])
    run()
    assert rows() == list(range(30))
    batch = logs.read(spark, folder).where("line_number = 7 and log_id is not null")
    for _ in range(2):
        stream.insert_batch(batch, 9, path)
    stream.insert_batch(batch.limit(0), 10, path)
    assert rows() == sorted([*range(30), 7])


@pytest.mark.parametrize("bad", [{"level": None}, {"message": "x" * 513}, {"log_id": "id", "timestamp": None}])
def test_a_refused_row_stops_its_batch_whole(spark, tmp_path, bad):
    folder, path, check = (str(tmp_path / x) for x in ("logs", "table", "check"))
    _write(folder, "a", [_line(i, True) for i in range(50)] + [_line(99, True, **bad)])
    with pytest.raises(Exception, match="refused record"):
        stream.insert_stream(stream.read_stream(spark, folder), path, check)
    assert stream.read_inserted(spark, path).count() == 0
    _write(folder, "a", [_line(i, True) for i in range(50)])  # mended: the same batch goes through
    stream.insert_stream(stream.read_stream(spark, folder), path, check)
    assert stream.read_inserted(spark, path).count() == 50


def test_table_demands_its_columns(spark):
    spark.sql("drop table if exists sent_once")
    logs.create_table(spark, "sent_once")
    demanded = {r["col_name"] for r in spark.sql("describe sent_once").collect()}
    assert demanded == set(COLUMNS) and logs.required_by(spark, "sent_once") == logs.REQUIRED
    rows = spark.createDataFrame([tuple(_line(i, True)[c] for c in COLUMNS) for i in range(40)], logs.SCHEMA).repartition(4)
    broken = rows.withColumn("level", F.when(F.col("line_number") != 30, F.col("level")))
    with pytest.raises(ValueError, match="level is null"):
        logs.insert(broken, "sent_once")
    assert spark.table("sent_once").count() == 0
    logs.insert(rows.withColumn("stack_trace", F.lit(None).cast("string")), "sent_once")
    assert spark.table("sent_once").count() == 40
    spark.sql("drop table sent_once")


def test_create_only_adds_what_is_missing(spark, tmp_path):
    folder = str(tmp_path / "logs")
    logs.create(spark, folder)
    made = {d: sorted(os.listdir(f"{folder}/{d}")) for d in os.listdir(folder) if d.startswith("category=")}
    assert set(made) == {"category=system", "category=api", "category=user"}
    logs.create(spark, folder)
    assert made == {d: sorted(os.listdir(f"{folder}/{d}")) for d in made} and logs.read(spark, folder).count() == 0


def test_contexts_of_all_kinds_in_one_file(spark, tmp_path):
    given = [{"k": 7, "who": {"name": "é"}}, '{"k": "8", "who": {}}', '{"k": [1', "plain words", "", None, "  ", "12.5", [1, 2], "[]", '"quoted"', True, 3, "null", {"k": 2**40, "extra": 1.5}, '{"k": true}']
    _write(str(tmp_path), "a", [_line(i, context=c) for i, c in enumerate(given)])
    got = logs.context_fields(logs.structured(logs.read_contexts(spark, str(tmp_path))), {"$.k": "long", "$.who.name": "string"})
    rows = {r["line_number"]: r for r in got.select("line_number", "context_kind", "context_text", "k", "who_name").collect()}
    kinds = ["object", "object", "text", "text", "none", "none", "none", "number", "array", "array", "text", "boolean", "number", "none", "object", "object"]
    assert [rows[i]["context_kind"] for i in range(len(given))] == kinds
    assert {i: rows[i]["context_text"] for i in rows if rows[i]["context_text"] is not None} == {2: '{"k": [1', 3: "plain words", 10: "quoted"}
    assert {i: rows[i]["k"] for i in rows if rows[i]["k"] is not None} == {0: 7, 1: 8, 14: 2**40, 15: 1} and rows[0]["who_name"] == "é"
    schema = {r["context_kind"]: (r["n"], r["fields"]) for r in logs.context_schema(got).collect()}
    assert schema["object"][0] == 4 and schema["object"][1].startswith("OBJECT<extra: DECIMAL") and "k: VARIANT" in schema["object"][1] and schema["none"][0] == 4
    as_text = logs.structured(logs.read(spark, str(tmp_path)))  # read as text, objects are text that holds an object
    assert {r["line_number"]: r["context_kind"] for r in as_text.collect() if r["context_kind"] == "object"} == {0: "object", 1: "object", 14: "object", 15: "object"}


def test_last_write_with_late_and_unordered_lines(spark, tmp_path):
    """Each event is told once, when the watermark passes its hour: with its second line if that came in time, in whatever order; what comes later changes nothing."""
    folder, out, check = (str(tmp_path / x) for x in ("logs", "out", "check"))
    files = [
        [_line(5), _line(10, True), _line(50)],
        [_line(10), _line(5, True, False), _line(65)],  # out of order, within the hour
        [_line(150)],  # the watermark passes the first two hours
        [_line(50, True), _line(140, True), _line(140)],  # 50's second line is too late
        [_line(500)],
    ]
    for n, lines in enumerate(files):
        _write(folder, f"f{n}", lines)
        stream.run_available(stream.latest_stream(stream.read_stream(spark, folder)), out, check)
    got = {r["line_number"]: (r["log_id"] is not None, r["synced_to_appwrite"]) for r in spark.read.parquet(out).collect()}
    assert got == {5: (True, False), 10: (True, True), 50: (False, False), 65: (False, False), 140: (True, True), 150: (False, False)}
    assert spark.read.parquet(out).count() == len(got)
