"""Files: acceptance, CSV reading with line numbers, exports, tables in the catalog."""

import pytest

from haulscope.operators import quality
from haulscope.sources import files, jdbc, tables
from haulscope.schemas import UPLOAD_COLUMNS

HEADER = ",".join(UPLOAD_COLUMNS)
LINE = "S{0},2024-01-01,Acme,Yard,1000,500,900.00,50"


def write(folder, name, *lines, encoding="utf-8"):
    (folder / name).write_bytes("\n".join(lines).encode(encoding))


def test_acceptance(spark, tmp_path, rows):
    write(tmp_path, "good.csv", HEADER, LINE.format(1))
    write(tmp_path, "sheet.xlsx", "x")
    write(tmp_path, "big.CSV", HEADER, *[LINE.format(i) for i in range(100)])
    report = files.file_report(spark, str(tmp_path), max_bytes=1000)
    found = {path.rsplit("/", 1)[1]: (ok, why) for path, _, ok, why in rows(report)}
    assert found["good.csv"] == (True, None)
    assert found["sheet.xlsx"] == (False, files.REFUSED_EXTENSION)
    assert found["big.CSV"][0] is False and "exceeds" in found["big.CSV"][1]


def test_default_limit_message(spark, tmp_path, rows):
    (tmp_path / "big.csv").write_bytes(b"x" * (files.MAX_BYTES + 1))
    (reason,) = rows(files.file_report(spark, str(tmp_path)), "reason")
    assert reason == "File size exceeds 10MB limit. Please split into smaller files."


def test_a_file_over_a_given_limit_is_an_error_and_there_is_no_limit_by_default(spark, tmp_path, rows):
    write(tmp_path, "small.csv", HEADER, LINE.format(1))
    write(tmp_path, "large.csv", HEADER, *[LINE.format(i) for i in range(100)])
    with pytest.raises(ValueError, match="exceeds"):
        files.read_upload(spark, str(tmp_path), max_bytes=1000)
    assert files.read_upload(spark, str(tmp_path)).count() == 101


def test_report_header_and_reader_agree_on_upper_case_names(spark, tmp_path, rows):
    write(tmp_path, "B.CSV", HEADER, LINE.format(1))
    write(tmp_path, "c.Csv", HEADER, LINE.format(2))
    assert files.file_report(spark, str(tmp_path)).where("accepted").count() == 2
    assert sorted(rows(files.read_upload(spark, str(tmp_path)), "shipment_id")) == ["S1", "S2"]


def test_line_numbers_do_not_depend_on_settings_of_a_later_scan(spark, tmp_path, rows):
    write(tmp_path, "a.csv", HEADER, *[LINE.format(i) for i in range(2, 3002)])
    keys = ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set(keys[1], "1000")
        read = files.read_upload(spark, str(tmp_path))
        spark.conf.set(keys[0], "16")
        spark.conf.set(keys[2], "9000")
        found = rows(read, "shipment_id", "row_num")
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(found) == 3000 and all(shipment == f"S{number}" for shipment, number in found)


def test_quoted_line_breaks(spark, tmp_path, rows):
    write(tmp_path, "u.csv", HEADER, LINE.format(1).replace("Acme", '"Ac\nme"'), LINE.format(2))
    read = files.read_upload(spark, str(tmp_path), multi_line=True)
    assert sorted(rows(read, "row_num", "shipment_id", "carrier")) == [(2, "S1", "Ac\nme"), (3, "S2", "Acme")]
    assert quality.messages(quality.check(read, [quality.malformed_line()])).count() == 0


def test_line_numbers_over_many_blocks(spark, tmp_path, rows):
    write(tmp_path, "a.csv", HEADER, *[LINE.format(i) for i in range(2, 3002)])
    write(tmp_path, "b.csv", HEADER, *[LINE.format(i) for i in range(2, 12)])
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "7000")
    try:
        read = files.read_upload(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 5
        found = rows(read, "shipment_id", "row_num")
    finally:
        spark.conf.set(key, old)
    assert len(found) == 3010
    assert all(shipment == f"S{number}" for shipment, number in found)


def test_malformed_lines_and_missing_values(spark, tmp_path, rows):
    write(
        tmp_path, "u.csv", HEADER, LINE.format(1), "S2,2024-01-01,Acme", LINE.format(3) + ",extra",
        'S4,2024-01-01,"Acme,Yard,1,2,3,4', "S5,NaN,N/A,null,1,2,3,n/a",
    )
    read = files.read_upload(spark, str(tmp_path)).orderBy("row_num")
    checked = quality.check(read, [quality.malformed_line()])
    assert rows(quality.messages(checked), "row_num") == [3, 4, 5]
    last = read.where("row_num = 6").first()
    assert (last.ship_date, last.carrier, last.facility, last.accessorial_charge_usd) == (None,) * 4


def test_header_only(spark, tmp_path):
    write(tmp_path, "u.csv", HEADER)
    read = files.read_upload(spark, str(tmp_path))
    assert quality.size_issue(read)["message"].startswith("CSV file is empty - no data rows found.")


def test_other_columns(spark, tmp_path):
    write(tmp_path, "u.csv", "shipment_id,Notes", "S1,hello")
    read = files.read_upload(spark, str(tmp_path))
    missing, extra = quality.frame_issues(read)
    assert "carrier" in missing["message"] and extra["message"].endswith("Notes")


def test_a_different_header_is_an_error(spark, tmp_path):
    write(tmp_path, "a.csv", "x,y", "1,2")
    write(tmp_path, "b.csv", "y,x", "2,1")
    with pytest.raises(Exception):
        files.read_upload(spark, str(tmp_path), ["x", "y"]).collect()


def test_encoding(spark, tmp_path, rows):
    write(tmp_path, "u.csv", HEADER, LINE.format(1).replace("Yard", "Frëïght Wårehouse"), encoding="latin-1")
    wrong = files.read_upload(spark, str(tmp_path))
    checked = quality.check(wrong, [quality.encoding_damage("facility")])
    assert rows(quality.messages(checked), "rule") == ["encoding"]
    right = files.read_upload(spark, str(tmp_path), encoding="ISO-8859-1")
    assert rows(right, "facility") == ["Frëïght Wårehouse"]


def test_text_that_looks_like_sql_is_only_text(spark, tmp_path, rows):
    nasty = "'; DROP TABLE Shipments; --"
    write(tmp_path, "u.csv", HEADER, LINE.format(1).replace("Acme", nasty))
    read = files.read_upload(spark, str(tmp_path))
    assert rows(read, "carrier") == [nasty]


def test_exports(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    files.export_csv(df, str(tmp_path / "csv"))
    assert sorted(rows(spark.read.option("header", True).csv(str(tmp_path / "csv")))) == [("1", "a"), ("2", "b")]
    padded = spark.createDataFrame([(" a  ",)], "v string")
    files.export_csv(padded, str(tmp_path / "padded"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "padded"))) == [" a  "]
    for _ in range(2):
        files.append_parquet(df, str(tmp_path / "pq"), partition_by="k")
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 4


def test_catalog(spark, rows):
    spark.sql("CREATE DATABASE IF NOT EXISTS freight_test")
    spark.range(30).write.mode("overwrite").saveAsTable("freight_test.zeta")
    spark.range(3).write.mode("overwrite").saveAsTable("freight_test.alpha")
    spark.range(3).createOrReplaceTempView("a_view")
    assert tables.list_tables(spark, "freight_test") == ["alpha", "zeta"]
    assert tables.list_tables(spark, "no_such_database") == []
    assert tables.preview(spark, "freight_test.zeta", 7).count() == 7
    assert tables.preview(spark, "freight_test.zeta").count() == 30
    spark.sql("DROP DATABASE freight_test CASCADE")


def test_fallback(spark):
    some, none = spark.range(3), spark.range(0)
    assert tables.or_else(some, none).count() == 3
    assert tables.or_else(none, some).count() == 3


def test_tables_from_parquet_and_catalog(spark, tmp_path, tables):
    from haulscope import FreightTables
    from haulscope.plans.carriers import carrier_metrics

    stored = {
        "shipments": tables.shipments, "accessorial_charges": tables.charges,
        "carriers": tables.carriers, "facilities": tables.facilities,
    }
    for name, df in stored.items():
        df.write.parquet(str(tmp_path / name))
        spark.read.parquet(str(tmp_path / name)).createOrReplaceTempView(name)
    expected = sorted(map(tuple, carrier_metrics(tables).collect()))
    for again in (FreightTables.from_parquet(spark, str(tmp_path)), FreightTables.from_catalog(spark)):
        assert sorted(map(tuple, carrier_metrics(again).collect())) == expected


def test_jdbc_options():
    url = jdbc.sql_server_url("host", "db")
    assert "encrypt=true" in url and "loginTimeout=30" in url
    options = jdbc.read_options(
        url, "Shipments", split_on="ShipDate", lower="2020-01-01", upper="2026-01-01", splits=64
    )
    assert options["numPartitions"] == "64" and options["partitionColumn"] == "ShipDate"
    with pytest.raises(ValueError):
        jdbc.read_options(url, "Shipments", split_on="ShipDate")
