"""Trim, key and lines on the edge cases that the driver's tables lack."""

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import WHITE_SPACE, key_of, lines, record_line, unicode_trim, value_of
from millrace.operators.text_jobs import distinct_lines, distinct_lines_by_partition

EDGES = [f"{c}k{c}j{c}" for c in WHITE_SPACE] + [
    "a\tb", "a\tc\td", " ", "", "​x​", "﻿x﻿", "\x1cx\x1c", "\x00x", "a\rb", "a\r", "a\nb ", "  \t　x \xa0 ",
]


def model(s: str) -> str:
    return s.strip(WHITE_SPACE).split("\t")[0]


def test_white_space_is_the_unicode_property():
    assert len(set(WHITE_SPACE)) == 25
    assert not set("​﻿\x1c\x1d\x1e\x1f") & set(WHITE_SPACE)


def test_trim_and_key(spark):
    df = spark.createDataFrame([(s,) for s in EDGES], "s string")
    got = [r.k for r in df.select(key_of(unicode_trim(F.col("s"))).alias("k")).collect()]
    assert got == [model(s) for s in EDGES]


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb\n", "\n\n", "a\rb\n c", "\r\n", "a\n\nb"])
def test_lines(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(lines(F.col("t"))).first()[0]
    want = text.split("\n")
    want = want[:-1] if want[-1] == "" else want
    assert got == [x.removesuffix("\r") for x in want]


def test_record_round_trip(spark):
    given = ["k", "k\t", "k\tv", "k\tv\tw", "\tv"]
    df = spark.createDataFrame([(s,) for s in given], "s string")
    parts = df.select("s", key_of(F.col("s")).alias("k"), value_of(F.col("s")).alias("v"))
    rows = parts.select("s", "k", "v", record_line(F.col("k"), F.col("v")).alias("back")).collect()
    assert [r.back for r in rows] == given
    assert [r.v for r in rows] == [None, "", "v", "v\tw", "v"]


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n\t\n",), ("b\na\nb",)], "text string")
    assert [r.key for r in distinct_lines(df).collect()] == ["a", "b"]
    assert [r.key for r in distinct_lines_by_partition(df).collect()] == ["a", "b"]
    assert distinct_lines(df.limit(0)).collect() == []


def test_order_is_by_bytes(spark):
    keys = ["Z", "a", "é", "￿", "\U00010000", "0"]
    df = spark.createDataFrame([("\n".join(keys),)], "text string")
    assert [r.key for r in distinct_lines(df).collect()] == sorted(keys, key=lambda k: k.encode())
