"""Secret scan: fixed patterns plus a randomness test battery, in SQL functions.

Base spans come from three patterns. The method adds spans of kind ``random``:
tokens of 16 or more encoding characters are given the narrowest encoding that
holds their characters (hexadecimal, base 32, base 64), and a battery of three
tests for uniform random symbols is made in that encoding: chi-squared
uniformity of the alphabet, runs above and below the alphabet's middle, and
serial correlation at lag 1.

Each test gives a p-value: the chance that a token which is not random, by that
test's measure, looks as random as this one does. For the alphabet that is
ordinary text of this length, whose symbols agree as often as ``ENCODINGS``
says; for runs and for the serial correlation it is a token that departs from
random by ``LEAST_EFFECT`` standard deviations a square root of a symbol. A
token is random only if all three are ruled out, so the p-value of the battery
is the largest of the three (the intersection-union rule). Longer tokens give
smaller ones. A Benjamini-Hochberg bound within each class of encoding and
length, over every token of the corpus that was tested, keeps the share of
false finds at ``FDR``; classes by length keep the many short words from
drowning long tokens.

Everything is a DataFrame expression. Matches are found by marking them with a
control character and splitting there; lengths of the pieces give positions in
code points. The character is exchanged for another control character before,
which no pattern holds, so positions stay. Only one row a text, with its few
candidates, is written to the shared folder; the table of bounds has at most
3 encodings x 64 lengths rows.

Defined results: a null text is the empty text and has no spans; repeated rows
give equal rows, and each counts as a hypothesis; tokens with equal evidence
are kept or dropped together; a text of any length is scanned whole, in memory
for its pieces between matches; an empty table gives no rows; other columns are
ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import materialize

#: The patterns and the least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,6}"
MARK, OTHER = "\x01", "\x02"
FDR = 0.01
#: Least departure of runs or of serial correlation that counts as structure, in standard deviations a square root of a symbol.
LEAST_EFFECT = 0.8
#: Alphabets, and the chance that two symbols of ordinary text in them agree.
ENCODINGS = {
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.15),
    "base32": ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.07),
    "base64": ("^[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.065),
}
BLOCK = 64


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def upto(n: Column) -> Column:
    """[0, n)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def spans(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches: array of (start, kind, end, s), in code points."""
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)

    def found(parts: Column) -> Column:
        def placed(lens: Column, sums: Column) -> Column:
            def one(k: Column) -> Column:
                i = k * 2 + 1
                b = F.floor(i / BLOCK).cast("int")
                start = _sum(F.slice(sums, F.lit(1), b)) + _sum(F.slice(lens, b * BLOCK + 1, i - b * BLOCK))
                return let(start, lambda at: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.get(lens, i)).alias("end"), F.get(parts, i).alias("s")))

            return F.transform(upto(F.floor(F.size(parts) / 2).cast("int")), one)

        def summed(lens: Column) -> Column:
            blocks = F.transform(upto(F.ceil(F.size(lens) / BLOCK).cast("int")), lambda b: _sum(F.slice(lens, b * BLOCK + 1, BLOCK)))
            return let(blocks, lambda sums: placed(lens, sums))

        none = F.array().cast("array<struct<start:int,kind:int,end:int,s:string>>")
        return F.when(F.size(parts) > 1, let(F.transform(parts, F.length), summed)).otherwise(none)

    return let(marked, found)


def base_spans(text: Column) -> Column:
    """All base spans, without failing matches, sorted by start and kind."""
    value = lambda m: F.regexp_extract(m["s"], ASSIGN, 2)
    assign = F.filter(spans(text, ASSIGN, 0), lambda m: F.length(value(m)) >= 12)
    return F.array_sort(F.concat(assign, spans(text, ACCESS, 1), spans(text, HEX, 2)))


def _evidence(z: Column) -> Column:
    """-log10 of about the chance of a normal deviate of ``z`` or more; 0 where ``z`` isn't positive."""
    return F.when(z > 0, 0.30103 + 0.43429 * (0.717 * z + 0.416 * z * z)).otherwise(F.lit(0.0))


def _battery(token: Column, alphabet: str, agree: float) -> Column:
    """-log10 of the battery's p-value for a token."""
    size = len(alphabet)
    half = "0" * (size // 2) + "1" * (size - size // 2)

    def with_chars(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        kinds = F.array_distinct(chars)
        squares = F.aggregate(
            kinds, F.lit(0.0), lambda s, c: s + F.pow((F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double"), F.lit(2.0))
        )
        chi = squares * size / n - n
        text_mean = size * (1 + (n - 1) * agree) - n
        text_sd = size * (2 * agree * (1 - agree)) ** 0.5
        uniform = _evidence((text_mean - chi) / text_sd)

        effect = F.sqrt(n) * LEAST_EFFECT
        bits = F.translate(token, alphabet, half)
        ones = F.length(F.replace(bits, F.lit("0"), F.lit(""))).cast("double")
        both = 2 * ones * (n - ones)
        runs = F.length(F.regexp_replace(bits, "0+|1+", "x"))
        spread = both * (both - n) / (n * n * (n - 1))
        z_runs = F.when(spread > 0, (runs - (1 + both / n)) / F.sqrt(spread)).otherwise(effect)
        places = F.transform(chars, lambda c: F.instr(F.lit(alphabet), c).cast("double"))

        def serial(xs: Column) -> Column:
            mean = F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / n
            off = F.transform(xs, lambda x: x - mean)

            def ratio(d: Column) -> Column:
                over = F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)
                lag = F.zip_with(F.slice(d, F.lit(1), F.size(d) - 1), F.slice(d, F.lit(2), F.size(d) - 1), lambda a, b: a * b)
                return F.when(over > 0, (F.aggregate(lag, F.lit(0.0), lambda s, x: s + x) / over + 1 / n) * F.sqrt(n)).otherwise(effect)

            return let(off, ratio)

        z_serial = let(places, serial)
        return F.least(uniform, _evidence(effect - F.abs(z_runs)), _evidence(effect - F.abs(z_serial)))

    return let(F.split(token, ""), with_chars)


def candidates(text: Column) -> Column:
    """Tokens with an encoding, and the battery's evidence that each is random."""

    def tested(m: Column) -> Column:
        s = F.translate(F.rtrim(m["s"], F.lit("=")), "_-", "/+")
        out = F.lit(None).cast("struct<encoding:string,evidence:double>")
        for name, (pattern, alphabet, agree) in reversed(ENCODINGS.items()):
            token = F.lower(s) if name == "hex" else s
            t = F.struct(F.lit(name).alias("encoding"), _battery(token, alphabet, agree).alias("evidence"))
            out = F.when(m["s"].rlike(pattern) & (F.length(s) >= 16), t).otherwise(out)
        return let(out, lambda t: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), t["encoding"].alias("encoding"), t["evidence"].alias("evidence")))

    return F.filter(F.transform(spans(text, TOKEN, 3), tested), lambda c: c["encoding"].isNotNull())


def _class() -> tuple[Column, Column]:
    return F.col("c.encoding").alias("encoding"), F.floor(F.log2(F.col("c.end") - F.col("c.start")) * 2).cast("int").alias("length")


def bounds(found: DataFrame, fdr: float) -> DataFrame:
    """Least evidence that is kept, by encoding and class of length (Benjamini-Hochberg over steps of 1/8)."""
    step = (
        found.select(F.explode("candidates").alias("c")).select(*_class(), F.floor(F.least(F.col("c.evidence"), F.lit(64.0)) * 8).alias("step"))
        .groupBy("encoding", "length", "step").agg(F.count(F.lit(1)).alias("n"))
    )
    own = Window.partitionBy("encoding", "length")
    above = own.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = step.select("*", F.sum("n").over(above).alias("found"), F.sum("n").over(own).alias("all"))
    kept = ranked.where(F.log10(F.col("all") / (F.col("found") * fdr)) <= F.col("step") / 8)
    return kept.groupBy("encoding", "length").agg((F.min("step") / 8).alias("least"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR, keep: bool = False) -> DataFrame:
    """doc_id, base and all: sorted arrays of (start, kind, end). keep: the whole row goes along as ``row``."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), MARK, OTHER)
    found = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("_id"),
            F.transform(base_spans(text), lambda m: m.dropFields("s")).alias("base"),
            candidates(text).alias("candidates"),
            *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []),
        ),
        "secret-spans",
    )
    least = bounds(found, fdr).agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "encoding", F.col("length").cast("string")), "least"))).alias("least")
    )
    kept = F.filter(
        "candidates",
        lambda c: c["evidence"]
        >= F.coalesce(F.try_element_at(F.col("least"), F.concat_ws(":", c["encoding"], F.floor(F.log2(c["end"] - c["start"]) * 2).cast("int").cast("string"))), F.lit(1e9)),
    )
    plain = F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return found.crossJoin(F.broadcast(least)).select(
        F.col("_id").alias("doc_id"), "base", F.array_sort(F.concat("base", plain)).alias("all"), *(["row"] if keep else [])
    )


def joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["start"].cast("string"), m["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, sign: str = "[secret]") -> Column:
    """The text with every run of touching spans replaced by ``sign``."""

    def put(acc: Column, m: Column) -> Column:
        return F.struct(
            F.when(m["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, m["start"] - acc["at"]), F.lit(sign))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], m["end"]).alias("at"),
        )

    built = F.aggregate(found, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), put)
    return F.when(F.size(found) == 0, text).otherwise(let(built, lambda b: F.concat(b["out"], F.substring(text, b["at"] + 1, F.length(text)))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """The rows of ``docs`` with secrets replaced in the text; a null text stays null."""
    found = scan(docs, id_col, text_col, fdr, keep=True)
    field = lambda c: F.col("row").getField(c)
    return found.select(*[(redacted(field(c), F.col("all")) if c == text_col else field(c)).alias(c) for c in docs.columns])


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda m: m["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"),
    )
