import csv
import io
import random

import pytest

from tidemark.sources import files as S
from tidemark.sources import records as R


@pytest.fixture
def small_splits(spark):
    """Splits of 64 bytes, so that they end inside quotes, between two quotes, and before line ends."""
    conf = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def plain(text):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    width = len(rows[0])
    return [tuple((x or None) for x in [*r, *[""] * width][:width]) for r in rows[1:]]


def as_texts(rows):
    return sorted((tuple(None if x is None else str(x) for x in r) for r in rows), key=repr)


def test_quoted_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'id,Free Note\r\n1,"two\nlines"\r\n2,"a ""b"" c\r\nd"\r\n\r\n3,5" pipe\r\n4,\r\n5,"x,\n"""\n')
    df = S.ingest_csv(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("id", "int"), ("free_note", "string")]
    assert sorted(map(tuple, df.collect())) == [(1, "two\nlines"), (2, 'a "b" c\r\nd'), (3, '5" pipe'), (4, None), (5, 'x,\n"')]


def test_doubled_quotes_without_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"a ""b"" c"\n2,"d, e"\n')
    assert sorted(map(tuple, S.ingest_csv(spark, str(tmp_path / "a.csv")).collect())) == [(1, 'a "b" c'), (2, "d, e")]


def test_equal_to_a_plain_reader_across_splits(spark, tmp_path, small_splits):
    rng = random.Random(11)
    for trial in range(4):
        end = ("\n", "\r\n", "\r", "\n")[trial % 4]
        rows = [["k", "note", "more"]]
        for i in range(rng.randint(10, 30)):
            value = lambda: "".join(rng.choice(['a', 'bc', ' ', '"', '""', ",", "\n", "\r\n", "\r", "é", "日"]) for _ in range(rng.choice([0, 2, 5, 40])))
            rows.append([f"r{i}", value(), value()])
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL if trial % 2 else csv.QUOTE_ALL).writerows(rows)
        path = tmp_path / f"{trial}.csv"
        path.write_bytes(out.getvalue().encode())
        df = S.ingest_csv(spark, str(path))
        assert as_texts(df.collect()) == as_texts(plain(out.getvalue())), trial


def test_files_of_a_folder_have_their_own_headers(spark, tmp_path, small_splits):
    for name, first in (("a", 1), ("b", 100)):
        rows = "".join(f'{first + i},"line\n{"x" * 70}\nend"\n' for i in range(5))
        (tmp_path / f"{name}.csv").write_text(f'"the\nid",note\n{rows}')
    df = S.ingest_csv(spark, str(tmp_path))
    assert df.columns == ["the_id", "note"] and sorted(r[0] for r in df.collect()) == [*range(1, 6), *range(100, 105)]


def test_numbers_marks_and_open_ends(spark, tmp_path):
    (tmp_path / "bare.csv").write_text('1,2\n3,"4\n"\n')
    bare = S.ingest_csv(spark, str(tmp_path / "bare.csv"))
    assert bare.columns == ["col_0", "col_1"] and sorted(map(tuple, bare.collect())) == [(1, "2"), (3, "4\n")]
    (tmp_path / "mark.csv").write_bytes("﻿id,t\n1,\"a\nb\"\n".encode())
    assert S.ingest_csv(spark, str(tmp_path / "mark.csv")).columns == ["id", "t"]
    (tmp_path / "latin.csv").write_bytes('id,t\n1,"caf\xe9\nb"\n'.encode("latin-1"))
    assert S.ingest_csv(spark, str(tmp_path / "latin.csv")).first()["t"] == "café\nb"
    (tmp_path / "open.csv").write_text('id,t\n1,"never\nclosed\n2,x\n')
    assert [tuple(r) for r in S.ingest_csv(spark, str(tmp_path / "open.csv")).collect()] == [(1, "never\nclosed\n2,x")]


def test_types_of_texts(spark):
    rows = [("1", "1", "1", "2024-01-02", "2024-01-02 03:04:05", "true", None, "1"), ("-2", "3000000000", "1e3", "2023-12-31", "2024-01-02T03:04:05Z", "False", None, "x"), (None,) * 8]
    df = R.typed(spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(8))))
    assert [t for _, t in df.dtypes] == ["int", "bigint", "double", "date", "timestamp", "boolean", "string", "string"]


def test_lines_as_functions_of_two_states():
    assert [R.scan(x, s)[0] for x in ("a,b", 'a,"b', 'a"b', '"a""', '"",""', "") for s in (False, True)] == [False, True, True, False, False, False, True, False, False, True, False, True]
    assert R.scan("a\rb\r", False) == (False, [1]) and R.scan('"a\rb\r', False) == (True, [])
