"""I-Match fingerprints over randomised lexicon subsets, in SQL functions.

The lexicon is the terms whose share of documents lies in a band: neither
common words nor words of a few documents. ``SPLITS`` random splits deal the
whole lexicon, each anew, to 2, 8, 32 or 64 subsets, 116 in all, so every term is in
six subsets that overlap in all ways. A text's distinct terms of the lexicon
are sorted, and the hash of those in a subset, in order, is that subset's part
of the fingerprint. Parts of large subsets agree for texts with nearly all
terms in common, parts of small ones for texts that share fewer. Two texts are
alike by the share of equal parts among the parts for which either has terms.

Document counts are taken over all documents, by partial sums in each task. A
term of the band is in one document of a thousand at least, so the lexicon has
at most a thousand times as many terms as a document has on average, whatever
the corpus. It goes to every task as the terms' 64-bit hashes in buckets of
about one, which are looked up in place; a term is in the lexicon only if its
whole hash is there.

Neighbours in order of document ids come from the ids alone: each document gets
its rank, and its predecessor's half length. The document then sends as much of
its text as that half, and its parts, to its predecessor. So texts move by
hashes of id and text, and no task holds a range of them.

Defined results: a null text is the empty text; a text without terms of the
lexicon has parts made from its whole text, so that equal texts still have
equal fingerprints; a null id stands last; among repeated ids the order is by
the text's hash, and each of several equal rows has the next one as its
successor, the last the next document; a table of one row has itself as its
next document; a text of any length is taken whole, in memory for its terms
six times; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.ranks import running
from millrace.llm.secrets import let
from millrace.storage import materialize

#: Bits of each split: a split of b bits deals the lexicon to 2 ** b subsets.
SPLITS = (1, 1, 3, 3, 5, 6)
SUBSETS = sum(1 << b for b in SPLITS)
#: Least and largest share of documents of a lexicon term.
BAND = (0.001, 0.01)
SEED = 6
KEY = ["nul", "id", "hash"]


def terms_of(text: Column) -> Column:
    """Distinct terms: runs of letters and digits, in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """One row: ``buckets``, the hashes of the band's terms by their lowest bits."""
    spark = docs.sparkSession
    n = docs.count()
    counts = docs.select(F.explode(terms_of(F.col(f"`{text_col}`"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band_ = counts.where((F.col("df") >= max(2, band[0] * n)) & (F.col("df") <= max(2, band[1] * n)))
    own = materialize(band_.select(F.xxhash64("term").alias("h")), "imatch-terms")
    slots = 1 << max(6, own.count().bit_length())
    held = own.groupBy(F.col("h").bitwiseAND(F.lit(slots - 1)).alias("id")).agg(F.collect_list("h").alias("hs"))
    none = F.array().cast("array<bigint>")
    all_ = spark.range(slots).join(held, "id", "left").select("id", F.coalesce("hs", none).alias("hs"))
    row = all_.groupBy().agg(F.array_sort(F.collect_list(F.struct("id", "hs"))).alias("rows"))
    return materialize(row.select(F.transform("rows", lambda r: r["hs"]).alias("buckets")), "imatch-lexicon")


def parts_of(text: Column, buckets: Column) -> Column:
    """The fingerprint's parts, as whole numbers; 0 where a subset has no terms of the text."""
    end = (1 << 31) - 1

    # A term's hash is cheaper than a place to keep it: Spark would make an array for it, for every term.
    def known(t: Column) -> Column:
        h = F.xxhash64(t)
        return F.array_contains(F.get(buckets, h.bitwiseAND((F.size(buckets) - 1).cast("long")).cast("int")), h)

    def subsets(term: Column, place: Column) -> Column:
        """For each split the term's subset, with the term's place in the lower half of the number."""

        def cut(h: Column) -> Column:
            out, first, bit = [], 0, 0
            for b in SPLITS:
                subset = F.shiftrightunsigned(h, bit).bitwiseAND(F.lit((1 << b) - 1).cast("long")) + first
                out.append(F.shiftleft(subset, 32).bitwiseOR(place.cast("long")))
                first, bit = first + (1 << b), bit + b
            return F.array(*out)

        return let(F.xxhash64(F.lit(SEED), term), cut)

    def hashed(piece: Column) -> Column:
        return F.greatest(F.shiftrightunsigned(F.xxhash64(piece), 33).cast("int"), F.lit(1))

    def dealt(terms: Column) -> Column:
        # Numbers sort by subset and then by term; an end stands after each subset's last term.
        ends = F.array(*[F.lit((j << 32) | end).cast("long") for j in range(SUBSETS)])
        numbers = F.sort_array(F.concat(F.flatten(F.transform(terms, subsets)), ends))
        place = lambda x: x.bitwiseAND(F.lit(end).cast("long")).cast("int")
        line = F.array_join(F.transform(numbers, lambda x: F.coalesce(F.get(terms, place(x)), F.lit("\n"))), " ")
        pieces = F.slice(F.split(line, "\n", -1), 1, SUBSETS)
        parts = F.transform(pieces, lambda p: F.when(F.trim(p) == "", F.lit(0)).otherwise(hashed(F.trim(p))))
        return F.when(F.size(terms) == 0, F.array_repeat(hashed(F.concat(F.lit(" "), text)), SUBSETS)).otherwise(parts)

    return let(F.array_sort(F.filter(terms_of(text), known)), dealt)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among those that are not empty on both sides."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != 0)), lambda z: z))
    some = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda z: z))
    return F.when(some > 0, same / some).otherwise(F.lit(1.0))


def written(parts: Column) -> Column:
    """Eight hexadecimal digits a part."""
    return F.array_join(F.transform(parts, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def neighbours(slim: DataFrame) -> DataFrame:
    """For each different row (nul, id, hash): to_nul, to_id, to_hash, its predecessor's, and need, half the predecessor's length."""
    rows = slim.groupBy(*KEY).agg(F.first("n_chars").alias("n_chars")).withColumn("one", F.lit(1).cast("long"))
    down = rows.withColumn("down", F.expr("~id"))
    ranked = materialize(running(down, ["nul", "down", "hash"], {"rank": "one"}, "imatch-order"), "imatch-ranks")
    n = max(1, ranked.count())
    before = ranked.select(*[F.col(k).alias(f"to_{k}") for k in KEY], F.floor(F.col("n_chars") / 2).cast("int").alias("need"), ((F.col("rank") + 1) % n).alias("rank"))
    return before.join(ranked.select(*KEY, "rank").hint("merge"), "rank").drop("rank")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    buckets = F.broadcast(lexicon(docs, text_col, band))
    id_ = F.col(f"`{id_col}`").cast("long")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(id_.isNull().alias("nul"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    wanted = neighbours(rows.select(*KEY, F.length("text").alias("n_chars")))
    # Equal rows become one, with their number. Both uses below read this shuffle's output, so they need the same columns.
    parts = rows.crossJoin(buckets).select(*KEY, "text", parts_of(F.col("text"), F.col("buckets")).alias("mine"))
    one = parts.groupBy(*KEY).agg(F.first("text").alias("text"), F.first("mine").alias("mine"), F.count(F.lit(1)).alias("copies"))
    sent = one.where("copies > 0").join(wanted.hint("merge"), KEY).select(
        *[F.col(f"to_{k}").alias(k) for k in KEY], F.substring("text", F.lit(1), F.col("need")).alias("start"), F.col("mine").alias("after")
    )
    met = one.where("copies > 0").join(sent.hint("merge"), KEY)
    half = F.floor(F.length("text") / 2).cast("int")
    again = F.struct((F.col("copies") - 1).alias("times"), F.substring("text", F.lit(1), half).alias("start"), F.col("mine").alias("after"))
    last = F.struct(F.lit(1).cast("long").alias("times"), F.col("start"), F.col("after"))
    turns = met.withColumn("turn", F.explode(F.when(F.col("copies") > 1, F.array(again, last)).otherwise(F.array(last))))
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.col("turn.start"))
    texts = turns.select(*KEY, F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "mine", "turn.after", "turn.times")
    done = texts.crossJoin(buckets).select(
        F.when(~F.col("nul"), F.col("id")).alias("doc_id"), "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "mine", "after", "times",
        parts_of(F.col("edited"), F.col("buckets")).alias("other"),
    )
    found = done.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("mine")).alias("fingerprint"), written(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("mine"), F.col("other")).alias("near_edited"), likeness(F.col("mine"), F.col("after")).alias("near_next"), "times",
    )
    return found.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    """All documents and their edited texts."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
