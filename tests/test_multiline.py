"""Quoted line breaks in files that are split: the same records as Python's csv, wherever blocks end."""

import csv
import io
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from haulscope.operators import quality
from haulscope.sources import files, multiline


@pytest.fixture()
def blocks(spark):
    """Cut files into blocks of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]

    def cut(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")

    yield cut
    for k, v in zip(keys, old, strict=True):
        spark.conf.set(k, v)


def table(seed, n, ending):
    """Rows of awkward cells as csv writes them."""
    rng = random.Random(seed)
    pieces = ["a", "b c", ",", '"', '""', "\n", "\r\n", "é", " ", "x\ny\nz", "5\" pipe", ""]
    out = io.StringIO()
    quoting = rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL, csv.QUOTE_NONNUMERIC])
    writer = csv.writer(out, lineterminator=ending, quoting=quoting)
    writer.writerow(["k", "p", "q"])
    for i in range(n):
        writer.writerow([f"r{i}", *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 5))) for _ in range(2))])
    return out.getvalue()


def by_csv(text):
    """Rows and the lines where they start; what stands for no value is None."""
    rows, at = [], 1
    reader = csv.reader(io.StringIO(text, newline=""))
    for row in reader:
        rows.append((at, [None if c in files.MISSING_TEXTS else c for c in row]))
        at = text.count("\n", 0, _offset(text, reader.line_num)) + 1
    return rows[1:]


def _offset(text, lines):
    """Where csv's own line count stands in the text (it counts \n, \r\n and \r)."""
    return len("".join(io.StringIO(text, newline="").readlines()[:lines]))


def read(spark, folder):
    found = files.read_quoted(spark, str(folder)).collect()
    return sorted((r.row_num, [r.k, r.p, r.q]) for r in found if r[files.CORRUPT] is None), found


@pytest.mark.parametrize("size", [61, 300, 1 << 20])
def test_records_equal_csv_at_every_block_size(spark, tmp_path, blocks, size):
    ending = "\r\n" if size == 300 else "\n"
    text = table(size, 25, ending)
    (tmp_path / "a.csv").write_bytes(text.encode())
    blocks(size)
    found, everything = read(spark, tmp_path)
    assert len(everything) == 25 and found == by_csv(text)


def test_several_files_and_stray_quotes(spark, tmp_path, blocks):
    texts = {f"{i}.csv": table(900 + i, 9, "\n").replace('"k","p","q"', "k,p,q", 1) for i in range(3)}
    texts["s.csv"] = 'k,p,q\n1,5" pipe,"x"y\n2,a"b"c,"multi\nline"\n3,"",""\n'
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    blocks(150)
    found = files.read_quoted(spark, str(tmp_path)).collect()
    for name, text in texts.items():
        mine = sorted((r.row_num, r.k) for r in found if r.file.endswith(f"/{name}"))
        assert mine == [(at, row[0]) for at, row in by_csv(text)]
    assert {r.p for r in found if r.file.endswith("/s.csv")} == {'5" pipe', 'a"b"c', None}
    assert [r.last_line for r in found if r.k == "2" and r.file.endswith("/s.csv")] == [4]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(['a', '"', '""', ',', 'bc', ' ', '","']), max_size=14))
def test_what_a_line_does_equals_csv(parts):
    """The two regular expressions, read by Python's re, against csv's own state."""
    import re

    line = "".join(parts)
    outside = bool(re.match(rf"\A{multiline._OPENS}".replace(r"\z", r"\Z"), line))
    inside = bool(re.match(rf"\A{multiline._TEXT}\Z", line)) or bool(
        re.match(rf'\A{multiline._TEXT}"(?:[^,"][^,]*+)?,{multiline._OPENS}'.replace(r"\z", r"\Z"), line)
    )
    for start, ends in (("", outside), ('"', inside)):
        opened = len(list(csv.reader(io.StringIO(f"{start}{line}\nnext\n")))) == 1
        assert opened is ends, (start, line)


@pytest.mark.parametrize("size", [25, 1 << 20])
def test_a_cell_without_an_end_is_reported_with_its_line(spark, tmp_path, blocks, size):
    lines = ["k,p,q", '1,"two\nlines",x', "2,b,c", '3,"never closed,d', "4,e,f", "5,g,h"]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    (tmp_path / "b.csv").write_text("k,p,q\n6,i,j\n")
    blocks(size)
    found = files.read_quoted(spark, str(tmp_path))
    rows = {r.k: r for r in found.collect()}
    assert set(rows) == {"1", "2", None, "6"} and rows["1"].p == "two\nlines"
    assert rows[None].row_num == 5 and rows[None].problem == "quoted cell opened in line 5 is never closed"
    messages = quality.messages(quality.check(found.withColumn("shipment_id", F.col("k")), [quality.malformed_line()]))
    assert [r.row_num for r in messages.collect()] == [5]


def test_records_that_are_too_long_are_reported(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,p,q\n1,"' + "x\n" * 30 + '",b\n2,c,d\n')
    found = multiline.read_records(spark, str(tmp_path), max_lines=20).collect()
    assert {(r.first, r.problem) for r in found} == {(1, None), (2, "record of line 2 has more than 20 lines"), (33, None)}


def test_short_and_long_records_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,p,q\n\n1,a\n2,b,c,d\n3,e,f\n\n")
    found = {r.row_num: r for r in files.read_quoted(spark, str(tmp_path)).collect()}
    assert {n: r[files.CORRUPT] is None for n, r in found.items()} == {3: False, 4: False, 5: True}
    (tmp_path / "b.csv").write_text("k,p\n1,a\n")
    with pytest.raises(ValueError, match="different headers"):
        files.read_quoted(spark, str(tmp_path))


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, blocks):
    (tmp_path / "a.csv").write_text("k,p,q\n" + "".join(f'{i},"a\nb",c\n' for i in range(2000)))
    blocks(1_500)
    lines = multiline.read_lines(spark, str(tmp_path))
    assert lines.select("block").distinct().count() > 10
    assert files.read_quoted(spark, str(tmp_path)).count() == 2000


def test_each_file_is_decoded_by_its_bytes(spark, tmp_path):
    text = "k,p,q\n1,Zoë – “x”,€5\n2,plain,z\n"
    (tmp_path / "w.csv").write_bytes(text.encode("cp1252"))
    (tmp_path / "u.csv").write_bytes(text.encode())
    found = files.read_quoted(spark, str(tmp_path)).collect()
    assert sorted((r.k, r.p, r.q) for r in found) == sorted([("1", "Zoë – “x”", "€5"), ("2", "plain", "z")] * 2)
    (warned,) = files.encoding_messages(spark, str(tmp_path)).collect()
    assert warned.file.endswith("/w.csv") and warned.message.startswith("1 of 3 lines are not UTF-8.")
