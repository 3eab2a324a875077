import random

import pytest

from tablewright.session import scratch_path
from tablewright.sources import csv, records

FIELDS = [
    "", "a", '"a"', '"a,b"', '"line\nbreak"', '"two\n\nbreaks"', '"a ""quoted"" word"', '"""\n"""', '""', '"\n"', '"x\ny,z"', "5 cm", "mid\"dle", "'", '"tail"x', '"a\r\nb"',
    '",\n,"', '"""start\nend"""', " lead", '"é\n日本"',
]


def write(folder, name, text):
    (folder / name).write_bytes(text.encode())


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def tiny_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_many_tasks_read_what_one_reads(spark, tmp_path, tiny_splits, seed, end):
    random.seed(seed)
    for k in range(3):
        lines = [",".join(random.choice(FIELDS) for _ in range(3)) for _ in range(60)]
        write(tmp_path, f"part{k}.csv", "one,two,three" + end + end.join(lines) + (end if k else ""))
    path = str(tmp_path)
    assert records.breaks_in_quotes(spark, path)
    assert records.lines_of(spark, path).select("file", "split").distinct().count() > 60
    found, whole = csv.csv_scan(spark, path), csv.csv_scan(spark, path, multiline=True)
    # Breaks inside quotes stay as they are written; the reader of whole files makes them those of the first line.
    same = lambda df: sorted(x.replace("\\r\\n", "\\n") for x in rows(df))
    assert found.schema == whole.schema and same(found) == same(whole)
    assert rows(csv.csv_scan(spark, path, "one string, two string, three string")) == rows(found)


def test_states_across_splits(spark, tmp_path, tiny_splits):
    """One field is longer than several splits; lines that close and open quotes come before and after it."""
    long = '"' + "\n".join(f'some words, {i} ""and"" more' for i in range(60)) + '"'
    write(tmp_path, "a.csv", f'h,k\n1,"x\ny"\n2,{long}\n"3\n","4"\n5,6\n')
    got = csv.csv_scan(spark, str(tmp_path))
    assert rows(got) == rows(csv.csv_scan(spark, str(tmp_path), multiline=True)) and got.count() == 4


def test_lines_of_a_split_are_not_sorted(spark, tmp_path, monkeypatch):
    """States go from batch to batch as lines are read; only splits are put in order."""
    size, ordered, along = "spark.sql.execution.arrow.maxRecordsPerBatch", [], records.open_after
    before = spark.conf.get(size)
    monkeypatch.setattr(records, "open_after", lambda maps, by, order: ordered.append(maps.count()) or along(maps, by, order))
    random.seed(9)
    lines = [",".join(random.choice(FIELDS) for _ in range(3)) for _ in range(60)]
    write(tmp_path, "a.csv", "one,two,three\n" + "\n".join(lines))
    spark.conf.set(size, "2")
    try:
        got = rows(csv.csv_scan(spark, str(tmp_path)))
    finally:
        spark.conf.set(size, before)
    assert ordered == [1]  # one split
    assert [x.replace("\\r\\n", "\\n") for x in got] == [x.replace("\\r\\n", "\\n") for x in rows(csv.csv_scan(spark, str(tmp_path), multiline=True))]


def test_tables_without_breaks_are_read_as_lines(spark, tmp_path):
    write(tmp_path, "a.csv", 'h,k\n1,"x ""y"""\n2,mid"dle\n\n3,\n')
    assert not records.breaks_in_quotes(spark, str(tmp_path))
    assert [tuple(r) for r in csv.csv_scan(spark, str(tmp_path)).collect()] == [("1", 'x "y"'), ("2", 'mid"dle'), ("3", None)]
    write(tmp_path, "a.csv", "h,k\n")
    assert csv.csv_scan(spark, str(tmp_path)).count() == 0


def test_sink_and_scan(spark):
    data = [(1, "a\nb"), (2, 'say "x"\n"y"'), (3, None), (5, ","), (6, " \n"), (7, " plain ")]
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame(data, "id int, text string")
    assert csv.csv_sink(df, path)
    assert rows(csv.csv_scan(spark, path, df.schema)) == rows(df)
