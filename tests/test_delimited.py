"""Delimited intake: separators and headers as written, quoted line breaks, rows that are too wide."""

import pytest

from cohort.sources import delimited


def put(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_separator_within_quotes_does_not_count(spark, tmp_path):
    df = delimited.read_delimited(spark, put(tmp_path, 'id;name;note\n1;a;"x;y,z"\n2;"b;b";\n'))
    assert [tuple(r) for r in df.collect()] == [(1, "a", "x;y,z"), (2, "b;b", None)]
    assert delimited.sniff_separator('a,"x;y;z;w",b') == "," and delimited.sniff_separator("one") == ","


@pytest.mark.parametrize("header", ["a,a,b", "a,,b", "a, ,b", ""])
def test_bad_headers_are_refused(spark, tmp_path, header):
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, put(tmp_path, f"{header}\n1,2,3\n" if header else ""))


def test_quoted_line_breaks(spark, tmp_path):
    path = put(tmp_path, 'id,note\n1,"x\ny"\n2,z\n')
    rows = [tuple(r) for r in delimited.read_delimited(spark, path, multi_line=True).collect()]
    assert rows == [(1, "x\ny"), (2, "z")]


def test_rows_that_are_too_wide_become_rejects(spark, tmp_path):
    path = put(tmp_path, 'a,b\n1,2\n3,4,5\n6\n7,"8,8"\n')
    rows, rejects = delimited.read_delimited(spark, path, with_rejects=True)
    assert sorted((r.a, r.b) for r in rows.collect()) == [(1, "2"), (6, None), (7, "8,8")]
    assert [r.line for r in rejects.collect()] == ["3,4,5"]


def test_text_tables_with_quoted_cells(spark):
    text = 'intro\na,b,b,\n1,"x, y",3,4\n"say ""hi""",,5\nend'
    df = spark.createDataFrame([(1, text), (2, None), (3, "no table"), (4, "x|y\nwider|than|it")], "doc_id long, text string")
    got = sorted(tuple(r) for r in delimited.extract_text_tables(df).collect() if r.value is not None)
    assert got == [(1, 2, "a", "1"), (1, 2, "b", "x, y"), (1, 2, "b_2", "3"), (1, 2, "column_4", "4"), (1, 3, "a", 'say "hi"'), (1, 3, "b_2", "5")]
