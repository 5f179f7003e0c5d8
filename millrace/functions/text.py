"""Text primitives as column expressions: lines, Unicode trim, key and value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 25 code points with the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
TAB = "\t"


def unicode_trim(text: Column) -> Column:
    """Without White_Space at both ends. (Spark's one-argument trim takes U+0020 only.)"""
    return F.btrim(text, F.lit(WHITE_SPACE))


def lines(text: Column) -> Column:
    """Array of the lines of a text: cut at LF, one CR before it dropped, no empty line after the last LF."""
    cut = F.split(text, "\n", -1)
    kept = F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)
    return F.transform(kept, lambda s: F.when(s.endswith("\r"), s.substr(F.lit(1), F.length(s) - 1)).otherwise(s))


def key_of(line: Column) -> Column:
    """What stands before the first tab; the whole line if there is none."""
    return F.substring_index(line, TAB, 1)


def value_of(line: Column) -> Column:
    """What stands after the first tab; null if there is none."""
    at = F.instr(line, TAB)
    return F.when(at > 0, line.substr(at + 1, F.length(line)))


def record_line(key: Column, value: Column) -> Column:
    """The line of a record: the key alone where the value is null."""
    return F.when(value.isNull(), key).otherwise(F.concat(key, F.lit(TAB), value))


def words(text: Column) -> Column:
    """Array of runs of ASCII letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")
