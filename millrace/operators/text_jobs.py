"""Ready jobs over texts, lines and pages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import key_of, lines, unicode_trim, value_of, words
from millrace.plans import mapreduce
from millrace.sources.text import read_lines

HOST = "^https?://([^/:?#]+)"
LINK = 'href="([^"]*)"'


def trimmed_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``line``: trimmed lines of a text column that are not empty."""
    line = df.select(F.explode(lines(F.col(text_col))).alias("line"))
    return line.select(unicode_trim(F.col("line")).alias("line")).where(F.col("line") != "")


def distinct_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``key`` of each distinct trimmed line, in order."""
    return trimmed_lines(df, text_col).select(key_of(F.col("line")).alias("key")).distinct().orderBy("key")


def line_count(df: DataFrame, text_col: str = "text") -> DataFrame:
    return trimmed_lines(df, text_col).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def word_count(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.select(F.explode(words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def inverted_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and the sorted ids of the texts that hold it, joined by commas: a row a word, so for tables whose commonest word fits one.

    ``postings`` has no such bound.
    """
    one = df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(words(F.col(text_col)))).alias("word"))
    ids = F.transform(F.array_sort(F.collect_set("id")), lambda x: x.cast("string"))
    return one.groupBy("word").agg(F.array_join(ids, ",").alias("docs"))


#: Ids of one block of postings.
BLOCK = 4096


def postings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """word, block and the sorted ids of the block that hold the word, joined by commas.

    A block is ``block`` ids in a row, so no row and no group is larger, however
    common a word is.
    """
    number = F.col(id_col).cast("long")
    one = df.select(number.alias("id"), F.expr(f"`{id_col}` div {block}").alias("block"), F.explode(F.array_distinct(words(F.col(text_col)))).alias("word"))
    ids = F.transform(F.array_sort(F.collect_set("id")), lambda x: x.cast("string"))
    return one.groupBy("word", "block").agg(F.array_join(ids, ",").alias("docs"))


def grep(df: DataFrame, needle: str, text_col: str = "text") -> DataFrame:
    """Rows whose text holds ``needle``."""
    return df.where(F.col(text_col).contains(needle))


def host_of(url):
    return F.regexp_extract(url, HOST, 1)


def url_host_count(pages: DataFrame) -> DataFrame:
    return pages.groupBy(host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def reverse_links(pages: DataFrame) -> DataFrame:
    """target and the number of pages that link to it."""
    targets = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1)))
    return pages.select("page_id", targets.alias("target")).groupBy("target").agg(F.count(F.lit(1)).alias("pages"))


def term_vector_per_host(pages: DataFrame) -> DataFrame:
    """host, word and count over the host's pages."""
    one = pages.select(host_of(F.col("url")).alias("host"), F.explode(words(F.col("html"))).alias("word"))
    return one.groupBy("host", "word").agg(F.count(F.lit(1)).alias("n"))


def key_values(df: DataFrame, line_col: str) -> DataFrame:
    """key and value of each line that is not empty."""
    line = F.col(line_col)
    return df.where(line != "").select(key_of(line).alias("key"), value_of(line).alias("value"))


def distinct_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map of lines to (trimmed line, 1)."""
    from millrace.functions.text import WHITE_SPACE

    for b in batches:
        found = [s for x in b.column(0).to_pylist() if x is not None and (s := x.strip(WHITE_SPACE))]
        split = [x.partition("\t") for x in found]
        values = [f"{v}\t1" if t else "1" for _, t, v in split]
        yield pa.record_batch([pa.array([k for k, _, _ in split], pa.string()), pa.array(values, pa.string())], names=["key", "value"])


def distinct_lines_by_partition(df: DataFrame, text_col: str = "text", num_reduces: int | None = None) -> DataFrame:
    """The same as ``distinct_lines`` through Arrow functions."""
    given = df.select(F.explode(lines(F.col(text_col))).alias("value"))
    made = mapreduce.partitions(given, distinct_map, mapreduce.by_key(lambda key, values: [key]), num_reduces)
    return mapreduce.in_order(made).select(F.col("line").alias("key"))


def distinct_pieces_map(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The same map as a function of pieces of a partition's bytes."""
    from millrace.functions.text import WHITE_SPACE

    for given in pieces:
        found = (x.strip(WHITE_SPACE) for x in given.decode("utf-8").split("\n"))
        yield "".join(f"{x}\t1\n" for x in found if x).encode("utf-8")


def distinct_pieces_reduce(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Each key of sorted records, once; of what was read only the last key is kept."""
    last = b""
    for given in pieces:
        out: list[bytes] = []
        for record in given.split(b"\n"):
            key = record.partition(b"\t")[0]
            if key and key != last:
                out.append(key)
                last = key
        yield b"".join(x + b"\n" for x in out)


def distinct_lines_of_files(spark: SparkSession, path: str, num_reduces: int | None = None) -> DataFrame:
    """Distinct trimmed lines of text files, by functions of pieces of a partition's bytes."""
    map_, reduce = mapreduce.as_pieces(distinct_pieces_map, "map"), mapreduce.as_pieces(distinct_pieces_reduce, "reduce")
    made = mapreduce.partitions(read_lines(spark, path), map_, reduce, num_reduces)
    return mapreduce.in_order(made).select(F.col("line").alias("key"))


def combined_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map of texts to (word, count), added up inside each batch."""
    import re

    find = re.compile("[a-z0-9]+").findall
    for b in batches:
        held: Counter = Counter()
        for t in b.column(0).to_pylist():
            held.update(find((t or "").lower()))
        yield pa.record_batch([pa.array(list(held), pa.string()), pa.array(map(str, held.values()), pa.string())], names=["key", "value"])


def word_count_by_partition(df: DataFrame, text_col: str = "text", num_reduces: int | None = None) -> DataFrame:
    """The same as ``word_count`` through Arrow functions with a combiner in map."""
    reduce = mapreduce.by_key(lambda key, values: [f"{key}\t{sum(map(int, values))}"])
    made = mapreduce.partitions(df.select(text_col), combined_words, reduce, num_reduces)
    return made.select(key_of(F.col("line")).alias("word"), value_of(F.col("line")).cast("long").alias("n"))


def values_in_order(df: DataFrame, key_col: str, value_col: str, order: list[str], num_reduces: int | None = None) -> DataFrame:
    """key and its values in the given order, joined by commas: the order is carried through the shuffle."""
    given = df.select(F.col(key_col).cast("string").alias("key"), F.col(value_col).cast("string").alias("value"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(order)])
    names = [f"_{k}" for k in range(len(order))]
    sorted_ = given.repartition(mapreduce.check_reduces(df.sparkSession, num_reduces), "key").sortWithinPartitions("key", *names).select("key", "value")
    from millrace.session import ship

    ship(df.sparkSession)
    made = sorted_.mapInArrow(mapreduce.by_key(lambda key, values: [f"{key}\t{','.join(v or '' for v in values)}"]), mapreduce.LINE)
    return made.select(key_of(F.col("line")).alias("key"), value_of(F.col("line")).alias("found"))
