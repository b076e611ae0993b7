import pytest

from quillveil.operators.timestamps import TimestampDictionary, parse_instant, p1_found

H = 3_600_000_000


@pytest.mark.parametrize(
    ("text", "zone", "order", "iso"),
    [
        ("2024-06-02T01:42:07", "Europe/Paris", "dmy", "2024-06-01T23:42:07"),
        ("03/04/2024", "UTC", "dmy", "2024-04-03T00:00:00"),
        ("03/04/2024", "UTC", "mdy", "2024-03-04T00:00:00"),
        ("2024/03/04 10:00", "UTC", "mdy", "2024-03-04T10:00:00"),
        ("04.03.24, 10:00", "UTC", "mdy", "2024-03-04T10:00:00"),
        ("2024-10-27 02:30:00", "Europe/Paris", None, "2024-10-27T00:30:00"),  # occurs twice: the first
        ("2024-03-31 02:30:00", "Europe/Paris", None, "2024-03-31T01:30:00"),  # skipped: the offset before
        ("Tue, 11 Jan 2022 20:08:03 -0800", None, None, "2022-01-12T04:08:03"),
        ("1587185403", None, None, "2020-04-18T04:50:03"),
        ("1582459076508", None, None, "2020-02-23T11:57:56.508000"),
        ("May 14, 2024 12:53 AM", "America/New_York", "mdy", "2024-05-14T04:53:00"),
        ("2022-01-06T07:18:09[Europe/Madrid]", None, None, "2022-01-06T06:18:09"),
        ("14 de septiembre de 2020 a las 07:58", "UTC", "dmy", "2020-09-14T07:58:00"),
        ("2025年7月27日 11:56", "Asia/Tokyo", None, "2025-07-27T02:56:00"),
        ("  20250605T071125Z\t", None, None, "2025-06-05T07:11:25"),
    ],
)
def test_forms(text, zone, order, iso):
    from datetime import datetime

    micros = parse_instant(text, zone, order)
    assert micros is not None
    assert micros == (datetime.fromisoformat(iso) - datetime(1970, 1, 1)).total_seconds() * 10**6


@pytest.mark.parametrize("text", [None, "", "  ", "demain", "2025", "10:30", "2021-23-17 25:15:20", "30/02/2022", "0000-00-00", "n/a", "Thu, 00 Jan 2023 10:00:00 +0100", "two weeks ago"])
def test_no_case(text):
    assert parse_instant(text, "UTC", "dmy") is None


def test_without_zone():
    assert parse_instant("2024-01-01 10:00", None, "dmy") is None
    assert parse_instant("2024-01-01 10:00", "Nowhere/None", "dmy") is None


def test_rows_and_increments(spark, tmp_path):
    boxes = spark.createDataFrame([("a", "Europe/Paris", "dmy"), ("b", None, None), (None, "UTC", "dmy")], "mailbox string, home_zone string, date_order string")
    rows = [(k, "2024-01-01 10:00:00" if k % 3 else "01/02/2024", "a") for k in range(60)] + [(100, None, "a"), (101, "2024-01-01", "b"), (102, "2024-01-01T00:00:00Z", None), (103, "x", "zzz")]
    samples = spark.createDataFrame(rows, "row_id bigint, date string, sender string").repartition(5)
    path = f"file://{tmp_path}/dict"
    found = {r.row_id: r.utc_micros for r in p1_found(spark, samples, boxes, path).collect()}
    assert len(found) == 61 and 101 not in found and 102 in found
    expected = {r[0]: parse_instant(r[1], "Europe/Paris" if r[2] == "a" else None, "dmy" if r[2] == "a" else None) for r in rows}
    assert found == {k: v for k, v in expected.items() if v is not None}
    before = TimestampDictionary(spark, path).entries().count()
    assert {r.row_id: r.utc_micros for r in p1_found(spark, samples, boxes, path).collect()} == found
    assert TimestampDictionary(spark, path).entries().count() == before  # nothing is parsed twice


def test_empty(spark):
    boxes = spark.createDataFrame([], "mailbox string, home_zone string, date_order string")
    samples = spark.createDataFrame([], "row_id bigint, date string, sender string")
    assert p1_found(spark, samples, boxes).count() == 0


def test_repeated_appends_change_nothing(spark, tmp_path):
    from quillveil.operators import timestamps

    boxes = spark.createDataFrame([("a", "UTC", "dmy")], "mailbox string, home_zone string, date_order string")
    samples = spark.createDataFrame([(1, "2024-01-01", "a"), (2, "x", "a")], "row_id bigint, date string, sender string")
    path = f"file://{tmp_path}/twice"
    first = p1_found(spark, samples, boxes, path).collect()
    dictionary = TimestampDictionary(spark, path)
    dictionary.entries().write.mode("append").parquet(dictionary.path)  # as a repeated or concurrent append would
    assert spark.read.parquet(dictionary.path).count() == 4 and dictionary.entries().count() == 2
    assert p1_found(spark, samples, boxes, path).collect() == first and len(first) == 1
    timestamps.PARSER_VERSION += 1
    try:
        assert TimestampDictionary(spark, path).entries().count() == 0  # another parser reads everything anew
    finally:
        timestamps.PARSER_VERSION -= 1


def test_work_folder(spark):
    from quillveil import runtime

    made = runtime.written(spark.range(3).toDF("x"), "for-a-test")
    path = runtime._WRITTEN[-1][1].removeprefix("file://")
    import os

    assert made.count() == 3 and os.path.isdir(path)
    runtime.remove_written(spark)
    assert not os.path.exists(path) and not runtime._WRITTEN

    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "yarn"}.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        runtime.work_dir(Session())
