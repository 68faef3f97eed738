"""Cut files give the rows that Spark's reader of whole files gives, wherever they are cut."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlab.sources.posts import _strings, read_delimited, read_posts, read_quoted
from postlab.sources.splittable import line_code, line_ends

SPLIT = "spark.sql.files.maxPartitionBytes"
TEXT = ('id\ttext\n'
        '1\t"a\nb ""quoted""\n\n"\n'
        '2\tplain 5" wide\n'
        '3\t""\n4\t\n\n'
        '5\t"""\n"\n'
        '"6\n"\t"x\ty\n"\n'
        '7\t"shut"then "open\n'
        '8\té€😀 "no\n'
        '9\t"' + "long\n" * 6 + 'end"\n'
        '10\tlast')


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def cut(spark):
    old = spark.conf.get(SPLIT)
    yield lambda size: spark.conf.set(SPLIT, str(size))
    spark.conf.set(SPLIT, old)


def test_cuts_at_many_positions(spark, cut, tmp_path):
    file = tmp_path / "a.tsv"
    file.write_text(TEXT, encoding="utf-8", newline="")
    whole = rows(read_delimited(spark, str(file), "\t"))
    assert ("1", 'a\nb "quoted"\n\n') in whole and ("3", "") in whole and ("4", None) in whole
    # A first cut at any byte, and many cuts at once.
    for size in [5, 16, *range(21, len(TEXT.encode()), 23)]:
        cut(size)
        read = read_quoted(spark, str(file), "\t")
        assert rows(read) == whole, size


def test_one_file_is_read_by_several_tasks(spark, cut, tmp_path):
    file = tmp_path / "a.tsv"
    file.write_text(TEXT, encoding="utf-8", newline="")
    cut(40)
    assert read_delimited(spark, str(file), "\t").rdd.getNumPartitions() == 1
    assert read_quoted(spark, str(file), "\t").rdd.getNumPartitions() > 4


def test_several_files_carriage_returns_and_schemas(spark, cut, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.csv").write_text(
            f'id,text\r\n{i},"a\r\nb"\r\n{i},"never closed\r\n', newline="")
    (folder / "empty.csv").write_text("")
    cut(11)
    read = rows(read_quoted(spark, str(folder), ","))
    assert [r[0] for r in read] == ["0", "0", "1", "1", "2", "2"]
    assert ("1", "a\r\nb") in read
    named = read_quoted(spark, str(folder), ",", _strings("x", "y", "z"))
    assert named.columns == ["x", "y", "z"] and named.filter("x = 'id'").count() == 3
    (folder / "other.csv").write_text("text,id\n1,2\n")
    with pytest.raises(Exception, match="another header"):
        read_quoted(spark, str(folder), ",").collect()


def test_posts_by_ranges(spark, cut, tmp_path):
    file = tmp_path / "p.tsv"
    head = "test_case\tid\tsource\tlanguage\ttext\n"
    file.write_text(head + "".join(f'c\t{i:03}\ts\tes\t"x\n{i}"\n' for i in range(50)))
    cut(64)
    read = read_posts(spark, str(file), "es", split=True)
    assert rows(read) == rows(read_posts(spark, str(file), "es"))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=30), st.integers(0, 1))
def test_line_ends_follow_the_codes_one_by_one(codes, start):
    want, state = [], start
    for code in codes:
        state = (code >> state) & 1
        want.append(state)
    assert line_ends(np.array(codes), start).tolist() == want


def test_line_codes(spark):
    lines = ["", "a,b", '"', 'a,"b', '"a","b"', '"a""b', 'x"y,z', '"a"b"c', 'a,"b""']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, line string")
    codes = [r.c for r in df.orderBy("i").select(line_code(F.col("line"), ",").alias("c")).collect()]
    assert codes == [2, 2, 1, 1, 0, 1, 0, 0, 1]
