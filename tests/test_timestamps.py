import pytest

from roadloom.operators.timestamps import dictionary, instant, with_instants

NOON = 1_704_110_400_000_000  # 2024-01-01 12:00 UTC


@pytest.mark.parametrize(
    ("text", "zone"),
    [
        ("2024-01-01T12:00:00Z", "America/New_York"), ("2024-01-01 13:00:00", ""), ("2024-01-01 13:00", "Europe/Rome"), ("1704110400", ""), ("1704110400000", "Asia/Kolkata"), ("1704110400000000", ""), ("1704110400.00", ""), ("20240101130000", ""),
        ("20240101T130000", ""), ("01/01/2024 13:00:00", ""), ("1/1/2024 13.00.00", ""), ("01.01.2024 13:00", ""), ("01-JAN-2024 01:00:00 PM", ""), ("1 gen 2024 13:00:00", ""), ("Mon, 01 Jan 2024 12:00:00 GMT", ""), ("Mon, 01 Jan 2024 07:00:00 -0500", ""),
        ("2024-01-01 12:00:00+00", ""), ("2024-01-01T12:00:00.000000999+00:00", ""), ("2024-001T12:00:00Z", ""), ("2024-01-01 07:00:00 EST", ""), ("01/01/2024 13:00:00 CET", "UTC"), (" 2024-01-01 13:00:00,000 ", ""), ("2024/01/01 12:00", "Etc/UTC"),
    ],
)
def test_noon(text, zone):
    assert instant(text, zone) == NOON


@pytest.mark.parametrize("text", [None, "", "  ", "null", "2024-01-01", "12:00:00", "09/2021", "31/02/2023 10:15:00", "2021-13-21 06:35:11", "0000-00-00 00:00:00", "2024-03-31 02:30:00", "2023-10-29 02:30:00", "20240331023000", "ieri alle 10:30", "20240101", "2024-01-01 25:00:00", "2024-01-01 12:00:00 XYZ"])
def test_no_single_instant(text):
    assert instant(text, "Europe/Rome") is None


def test_settled_by_the_text():
    assert instant("29/10/2023 02:30:00 CEST", "") + 3_600_000_000 == instant("29/10/2023 02:30:00 CET", "")
    assert instant("2023-03-26 01:20:28", "Europe/Lisbon") is None
    assert instant("2023-03-26 01:20:28", "UTC") is not None


def test_dictionary_grows_and_rows_stay(spark, tmp_path):
    path = str(tmp_path / "dictionary")
    rows = spark.createDataFrame([("a", "1704110400", None), ("b", "1704110400", " UTC"), ("c", None, "UTC"), ("d", "", None), ("e", "nonsense", "No/Where"), ("f", "1704110400", None)], "id string, ts_text string, tz_data string")
    got = {r.id: r.epoch_us for r in with_instants(rows, path=path).collect()}
    assert got == {"a": NOON, "b": NOON, "c": None, "d": None, "e": None, "f": NOON}
    assert spark.read.parquet(path).count() == 3
    more = spark.createDataFrame([("g", "1704110401", None), ("a", "1704110400", None)], "id string, ts_text string, tz_data string")
    assert dictionary(more, "ts_text", "tz_data", path).count() == 4
    assert with_instants(rows.limit(0), path=str(tmp_path / "other")).count() == 0


def test_the_dictionary_is_used_again_and_two_writers_do_no_harm(spark, tmp_path):
    path = str(tmp_path / "dictionary")
    rows = spark.createDataFrame([("a", "1704110400", None), ("b", "nonsense", None)], "id_fcd string, ts_text string, tz_data string")
    assert with_instants(rows, path=path).count() == 2
    files = sorted(p.name for p in (tmp_path / "dictionary").iterdir())
    assert with_instants(rows, path=path).count() == 2 and sorted(p.name for p in (tmp_path / "dictionary").iterdir()) == files  # nothing new, nothing written
    spark.read.parquet(path).write.mode("append").parquet(path + "-copy")
    spark.read.parquet(path + "-copy").write.mode("append").parquet(path)
    assert spark.read.parquet(path).count() == 4 and with_instants(rows, path=path).count() == 2
    wrong = spark.createDataFrame([("1704110400", "", 7)], "raw string, zone string, epoch_us bigint")
    wrong.write.parquet(str(tmp_path / "given"))  # what the table holds isn't parsed again
    assert {r.id_fcd: r.epoch_us for r in with_instants(rows, path=str(tmp_path / "given")).collect()} == {"a": 7, "b": None}
