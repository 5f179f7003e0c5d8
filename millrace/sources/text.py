"""Line sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of the generator: words of 3 to 20 small letters.
SHORTEST, LONGEST = 3, 20
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def read_lines(spark: SparkSession, path: str, strict_utf8: bool = True) -> DataFrame:
    """``value``: the lines of the files at ``path``, cut at LF only and never in the middle.

    strict_utf8: a line that isn't valid UTF-8 fails the job; else its bad
    bytes become U+FFFD.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    if strict_utf8:
        return raw.select(F.validate_utf8("value").alias("value"))
    return raw.select(F.make_valid_utf8("value").alias("value"))


def generated_rows(megabytes: int) -> int:
    """Number of generated lines of about so many MiB, and not less."""
    mean = (SHORTEST + LONGEST) / 2 + 1
    return int(megabytes * (1 << 20) / mean * 1.01) + (1 if megabytes else 0)


def generated_lines(spark: SparkSession, megabytes: int, seed: int = 0) -> DataFrame:
    """``value``: about ``megabytes`` MiB, and not less, of random words, one a line; a seed gives the same lines again.

    A line is a function of its number and the seed: two halves of an MD5 digest
    are whole numbers whose digits to the base 26 are the letters, and the
    digest's last byte gives the length.
    """
    if megabytes < 0:
        raise ValueError("megabytes must not be negative")
    digest = spark.range(generated_rows(megabytes)).select(F.md5(F.concat_ws(":", F.col("id"), F.lit(seed)).cast("binary")).alias("d"))
    number = lambda at, size: F.conv(F.substring("d", at, size), 16, 10).cast("long")
    cut = digest.select(number(1, 15).alias("a"), number(16, 15).alias("b"), (number(31, 2) % (LONGEST - SHORTEST + 1) + SHORTEST).cast("int").alias("size"))
    letter = lambda half, k: F.substring(F.lit(LETTERS), F.expr(f"cast({half} div {26**k}L % 26 as int) + 1"), F.lit(1))
    letters = [letter("a" if k < 10 else "b", k % 10) for k in range(LONGEST)]
    return cut.select(F.substring(F.concat(*letters), F.lit(1), F.col("size")).alias("value"))


def write_text(lines: DataFrame, path: str, column: str = "value", one_file: bool = False) -> None:
    """Write lines as text, in order; ``one_file`` brings a result that is known to be small to one task."""
    out = lines.select(F.col(column).cast("string").alias("value"))
    (out.coalesce(1) if one_file else out).write.option("lineSep", "\n").text(path)
