"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of ``BLOCK`` words. Slot i stands at the van der
Corput point of i, its binary digits mirrored, and belongs to the source in
whose part of the cumulative weights the point lies. With 2**m slots the
points are the multiples of 2**-m in another order, so a source gets its
number of slots to within one, and any stretch of the mix has nearly its
shares. The k-th slot of a source takes the source's k-th block: its documents
in the order of a seeded hash, cut every ``BLOCK`` words, over again when all
are used, twice at most.

Since the points are a permutation of whole numbers, each source makes its own
slots from its interval, and a slot's rank within its source is a count of
whole numbers by their low digits: neither needs a shuffle or a window over a
source. Positions of documents are running totals over one total order
(``ranks.running``), so a source with a third of all rows is dealt over many
tasks. All sums are in whole numbers, so reruns agree.

Defined results: a null text has size 0 and is never taken; a null source is a
source of its own, the last; repeated rows each have their own place, and rows
with equal hashes stand by id and size; a text of any length is counted whole,
without a list of its words; an empty table gives no rows; other columns are ignored by ``taken_words`` and kept by
``mix_documents``, which gives a document as many times as half or more of its
words are taken, and a document without words once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.ranks import running
from millrace.storage import materialize

BLOCK = 64
#: Targets in whole parts of a word.
PART = 1024
CHUNK = 1 << 12
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, int]:
    """By source (nul, src): source_size, before (words of earlier sources), target; and the sum of all sizes.

    Targets share ``share`` of all words by weight and stop at ``most`` times
    the source's words; what is over goes to the others by weight, until none
    is above.
    """
    sums = rows.groupBy("nul", "src").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = running(sums, ["nul", "src"], {"before": "source_size", "rank": "one"}, "mix-sources")
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    table = materialize(ranked.withColumn("weight", F.get(kinds, F.col("rank") % len(weights))), "mix-weights")
    total, weight = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = share * total / weight if weight else 0.0
    while weight:
        full = F.col("weight") * level > most * F.col("source_size")
        held, free = table.agg(F.sum(F.when(full, most * F.col("source_size")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (share * total - held) / free if free else level
        if not new > level:
            break
        level = new
    return table.withColumn("target", F.least(F.col("weight") * level, most * F.col("source_size"))), int(total)


def mirrored(x: Column, bits: int) -> Column:
    """The lowest ``bits`` binary digits of ``x`` in reverse order."""
    for step, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        m = F.lit(mask)
        x = F.shiftrightunsigned(x, step).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), step))
    x = F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))
    return F.shiftrightunsigned(x, 64 - bits) if bits else F.lit(0).cast("long")


def rank_in_interval(x: Column, first: Column, end: Column, bits: int) -> Column:
    """How many y in [first, end) have a smaller mirror image than x.

    These agree with x in the lowest j digits and have 0 where x has 1 next,
    for some j: for each j a count of whole numbers of one rest.
    """

    def add(total: Column, j: Column) -> Column:
        rest = lambda n: F.call_function("shiftrightunsigned", n - 1 - low + step, j + 1)
        step = F.call_function("shiftleft", F.lit(2).cast("long"), j)
        low = x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), j) - 1)
        return total + F.when(F.bit_get(x, j) == 1, rest(end) - rest(first)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.array(*[F.lit(j) for j in range(bits)]).cast("array<int>"), F.lit(0).cast("long"), add)


def schedule(targets: DataFrame, block: int = BLOCK, most: int = 2) -> DataFrame:
    """Slots of the mix: slot, nul, src, rank, block, epoch. targets: as from ``source_targets``."""
    parts = targets.withColumn("parts", F.round(F.col("target") * PART).cast("long"))
    placed = materialize(running(parts, ["nul", "src"], {"at": "parts"}, "mix-targets"), "mix-intervals")
    whole = placed.agg(F.coalesce(F.max(F.col("at") + F.col("parts")), F.lit(0))).first()[0]
    unit = PART * block
    bits = max(0, (-(-int(whole) // unit) - 1).bit_length())
    up = lambda c: F.expr(f"({c} + {unit - 1}) div {unit}")
    own = placed.select("nul", "src", up("at").alias("first"), up("at + parts").alias("end"), F.expr(f"(source_size + {block - 1}) div {block}").alias("blocks"))
    chunks = own.where("end > first").select("*", F.explode(F.sequence(F.col("first"), F.col("end") - 1, F.lit(CHUNK).cast("long"))).alias("from"))
    # A number of partitions, since Spark would otherwise put these few rows, which grow a thousandfold, into one task.
    tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(tasks, "nul", "src", "from")
    points = dealt.select("*", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK, F.col("end")) - 1)).alias("x"))
    ranked = points.select("nul", "src", "blocks", mirrored(F.col("x"), bits).alias("slot"), rank_in_interval(F.col("x"), F.col("first"), F.col("end"), bits).alias("rank"))
    return ranked.where(F.col("rank") < F.col("blocks") * most).select(
        "slot", "nul", "src", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.expr("rank div blocks").alias("epoch")
    )


def placed_rows(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows with ``at``, the place of their first word in their source's shuffled words, and a number."""
    shuffled = rows.withColumn("_one", F.lit(1).cast("long"))
    found = running(shuffled, ["nul", "src", "mix_key", "doc_id", "size"], {"_at": "size", "row": "_one"}, "mix-rows")
    own = targets.select("nul", "src", "before", "source_size", "target")
    return found.join(own, ["nul", "src"]).withColumn("at", F.col("_at") - F.col("before")).drop("_at", "_one", "before")


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """row, nul, src, block, words: what each block holds of each row."""
    first, last = F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}")
    cut = placed.where("size > 0").select("row", "nul", "src", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.col("at"), F.col("block") * block)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    return cut.select("row", "nul", "src", "block", (end - start).alias("words"))


def take(rows: DataFrame, block: int, weights, share: float, most: int) -> DataFrame:
    """``rows`` (doc_id, nul, src, size, mix_key, ...) with source_size, target and taken."""
    targets, _ = source_targets(rows, weights, share, float(most))
    targets = materialize(targets, "mix-shares")
    placed = materialize(placed_rows(rows, targets), "mix-placed")
    # Spark takes the schedule, made from a few rows, for small: it must not be broadcast.
    used = schedule(targets, block, most).groupBy("nul", "src", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = pieces(placed, block).join(used.hint("merge"), ["nul", "src", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return placed.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def slim_rows(docs: DataFrame, id_: Column, text: Column, source: Column, seed: int, keep: list[Column] = ()) -> DataFrame:
    return docs.select(
        id_.cast("long").alias("doc_id"),
        source.isNull().alias("nul"),
        F.coalesce(source.cast("string"), F.lit("")).alias("src"),
        words_in(text).alias("size"),
        F.xxhash64(F.lit(seed), id_, text).alias("mix_key"),
        *keep,
    )


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, weights=WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 8) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    rows = materialize(slim_rows(docs, *[F.col(f"`{c}`") for c in (id_col, text_col, source_col)], seed), "mix-sizes")
    return take(rows, block, weights, share, most).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, weights=WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 8) -> DataFrame:
    """The rows of ``docs`` that the mix takes, repeated as often as it takes them."""
    # Rows get a number that is written down with them; all but the last join is on numbers and sizes.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = [F.col(f"`{c}`") for c in (id_col, text_col, source_col)]
    whole = materialize(slim_rows(docs, *own, seed, [F.monotonically_increasing_id().alias("number"), row]), "mix-documents")
    mixed = take(whole.drop("row"), block, weights, share, most)
    copies = F.when(F.col("size") == 0, F.lit(1).cast("long")).otherwise(F.expr("(2 * taken + size) div (2 * size)"))
    times = mixed.select("number", copies.alias("copies")).where("copies > 0")
    # By a shuffle at every size: the numbers grow with the rows.
    numbered = whole.select("number", "row").join(times.hint("merge"), "number").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return numbered.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed to weights 5, 2, 1 at 150 % of their words."""
    return taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
