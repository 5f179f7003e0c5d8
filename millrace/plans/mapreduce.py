"""Map, shuffle by key, reduce in key order: as columns, or as Arrow functions.

``columns`` keeps the whole job in Catalyst: map is expressions, reduce is
aggregates, and Spark adds partial sums before the shuffle. ``partitions`` takes
arbitrary functions: map sees a partition's batches, reduce sees a partition of
records in key order, once, over all its keys. ``by_key``, ``as_pieces`` and
``as_bytes`` turn simpler functions into such.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import key_of, record_line, value_of
from millrace.session import ship

Batches = Iterator[pa.RecordBatch]
RECORD = "key string, value string"
LINE = "line string"


def check_reduces(spark: SparkSession, num_reduces: int | None) -> int:
    """The number of reduces; the session's number of shuffle partitions if none is given."""
    if num_reduces is None:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    if num_reduces < 1:
        raise ValueError(f"num_reduces must be 1 or more, not {num_reduces}")
    return num_reduces


def columns(df: DataFrame, key: Column, aggregates: list[Column], where: Column | None = None, rows: Column | None = None) -> DataFrame:
    """One row a key. rows: an array to explode first, seen by the others as ``row``."""
    if rows is not None:
        df = df.select("*", F.explode(rows).alias("row"))
    df = df.withColumn("key", key)
    return (df if where is None else df.where(where)).groupBy("key").agg(*aggregates)


def records(lines: DataFrame, column: str = "value") -> DataFrame:
    """key and value of lines; empty lines go."""
    line = F.col(column)
    return lines.where(line != "").select(key_of(line).alias("key"), value_of(line).alias("value"))


def shuffled(mapped: DataFrame, num_reduces: int | None = None, value_order: bool = False) -> DataFrame:
    """Records in ``num_reduces`` partitions by key, each in key order.

    value_order: values of a key stay in the order in which map emitted them,
    by partition of the input and place in it.
    """
    num_reduces = check_reduces(mapped.sparkSession, num_reduces)
    if not value_order:
        return mapped.repartition(num_reduces, "key").sortWithinPartitions("key")
    numbered = mapped.withColumn("_ord", F.monotonically_increasing_id())
    return numbered.repartition(num_reduces, "key").sortWithinPartitions("key", "_ord").drop("_ord")


def partitions(
    df: DataFrame,
    map: Callable[[Batches], Batches],  # noqa: A002
    reduce: Callable[[Batches], Batches],
    num_reduces: int | None = None,
    value_order: bool = False,
    schema: str = LINE,
    most_ratio: float | None = None,
) -> DataFrame:
    """Arrow functions on both sides. map gives key and value (non-null key); reduce gives ``schema``.

    most_ratio: a task fails once it has made more than so many times the bytes
    that it has read (1,024 bytes at least are allowed).
    """
    num_reduces = check_reduces(df.sparkSession, num_reduces)
    ship(df.sparkSession)
    if most_ratio is not None:
        map, reduce = capped(map, most_ratio), capped(reduce, most_ratio)  # noqa: A001
    return shuffled(df.mapInArrow(map, RECORD), num_reduces, value_order).mapInArrow(reduce, schema)


def capped(fn: Callable[[Batches], Batches], most_ratio: float) -> Callable[[Batches], Batches]:
    """``fn`` that fails as soon as its output is larger than ``most_ratio`` times what it has read."""

    def run(batches: Batches) -> Batches:
        read = made = 0

        def counted() -> Batches:
            nonlocal read
            for b in batches:
                read += b.nbytes
                yield b

        for out in fn(counted()):
            made += out.nbytes
            if made > max(1024, most_ratio * read):
                raise ValueError(f"a task made {made} bytes of {read}")
            yield out

    return run


def in_order(lines: DataFrame, column: str = "line") -> DataFrame:
    """Total order of lines as they stand in a file, each with its LF: a tab sorts before a line's end."""
    return lines.orderBy(F.concat(F.col(column), F.lit("\n")))


def by_key(fn: Callable[[str, Iterator[str | None]], Iterable[str]], rows_a_batch: int = 10_000) -> Callable[[Batches], Batches]:
    """A reduce from a function of (key, values): values are read as they come, over batches."""

    def reduce(batches: Batches) -> Batches:
        def pairs() -> Iterator[tuple[str, str | None]]:
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())

        source = pairs()
        ahead = next(source, None)
        out: list[str] = []
        while ahead is not None:
            key = ahead[0]

            def values() -> Iterator[str | None]:
                nonlocal ahead
                while ahead is not None and ahead[0] == key:  # noqa: B023
                    value = ahead[1]
                    ahead = next(source, None)
                    yield value

            own = values()
            out += fn(key, own)
            for _ in own:  # what fn left unread
                pass
            if len(out) >= rows_a_batch:
                yield pa.record_batch([pa.array(out, pa.string())], names=["line"])
                out = []
        if out:
            yield pa.record_batch([pa.array(out, pa.string())], names=["line"])

    return reduce


#: About so many bytes of text are given to a function of pieces at once, and about so many become one batch.
PIECE = 1 << 20
_ROWS = 1_000


def _lines_given(batches: Batches, stage: str) -> Iterator[bytes]:
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            cols = [c.to_pylist() for c in b.slice(at, _ROWS).columns]
            if stage == "map":
                yield from (f"{x}\n".encode() for x in cols[0] if x is not None)
            else:
                yield from (f"{k}\n".encode() if v is None else f"{k}\t{v}\n".encode() for k, v in zip(*cols))


def _pieces(raw: Iterable[bytes]) -> Iterator[bytes]:
    """Whole lines, together until they have ``PIECE`` bytes."""
    held, size = [], 0
    for x in raw:
        held.append(x)
        size += len(x)
        if size >= PIECE:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def _whole_lines(made: Iterable[bytes]) -> Iterator[bytes]:
    """The same bytes, cut after LFs into about ``PIECE`` bytes."""
    rest: list[bytes] = []
    for x in made:
        at = 0
        while at < len(x):
            cut = x.rfind(b"\n", at, at + PIECE)
            if cut < 0:
                cut = x.find(b"\n", at + PIECE)
            if cut < 0:
                rest.append(x[at:])
                break
            yield b"".join([*rest, x[at : cut + 1]])
            rest, at = [], cut + 1
    if rest:
        yield b"".join(rest)


def as_pieces(fn: Callable[[Iterator[bytes]], Iterable[bytes]], stage: str, strict_utf8: bool = True, most_ratio: float | None = None) -> Callable[[Batches], Batches]:
    """A map or reduce from a function of a partition's text that comes, and is given, in pieces.

    fn gets an iterator over pieces of whole lines (a key's records may go over
    several) and gives pieces that may end anywhere. Neither the partition nor
    its result is held in memory. most_ratio: fail as soon as the output is
    larger than so many times what was read (1,024 bytes at least are allowed).
    """
    if stage not in ("map", "reduce"):
        raise ValueError("stage is map or reduce")

    def run(batches: Batches) -> Batches:
        read = size = 0

        def given() -> Iterator[bytes]:
            nonlocal read
            for x in _pieces(_lines_given(batches, stage)):
                read += len(x)
                yield x

        def made(source: Iterator[bytes]) -> Iterator[bytes]:
            nonlocal size
            for x in fn(source):
                size += len(x)
                if most_ratio is not None and size > max(1024, most_ratio * read):
                    raise ValueError(f"{stage} made {size} bytes of {read}")
                yield x

        source = given()
        first = next(source, None)
        if first is None:
            return
        for raw in _whole_lines(made(chain([first], source))):
            rows = [x for x in raw.decode("utf-8", "strict" if strict_utf8 else "replace").split("\n") if x]
            if stage == "reduce":
                yield pa.record_batch([pa.array(rows, pa.string())], names=["line"])
                continue
            split = [x.partition("\t") for x in rows]
            yield pa.record_batch(
                [pa.array([k for k, _, _ in split], pa.string()), pa.array([v if t else None for _, t, v in split], pa.string())], names=["key", "value"]
            )

    return run


def as_bytes(fn: Callable[[bytes], bytes], stage: str, strict_utf8: bool = True, most_ratio: float | None = None) -> Callable[[Batches], Batches]:
    """A map or reduce from a function of a whole partition's text, for jobs that were written so.

    The partition is held in memory, as such a function asks; ``as_pieces`` has
    no such need. most_ratio: fail when the output is larger than so many times
    the input (1,024 bytes at least are allowed).
    """
    return as_pieces(lambda pieces: [fn(b"".join(pieces))], stage, strict_utf8, most_ratio)


def lines_of(found: DataFrame) -> DataFrame:
    """``line`` from key and value."""
    return found.select(record_line(F.col("key"), F.col("value")).alias("line"))
