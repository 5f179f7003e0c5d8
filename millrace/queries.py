"""The library's own queries and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import WHITE_SPACE
from millrace.operators import tables, text_jobs
from millrace.plans import mapreduce
from millrace.sources.text import LETTERS, LONGEST, SHORTEST, generated_lines, generated_rows, write_text
from millrace.storage import new_path

PRICE = 450_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on(name: str, job: Callable[..., DataFrame], *more: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: job(*[_read(spark, sf_dir, t) for t in (name, *more)], **options)


def key_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return text_jobs.key_values(docs.select(F.concat_ws("\t", "source", "lang", F.col("doc_id").cast("string")).alias("line")), "line")


def total_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return mapreduce.in_order(docs.select(F.concat_ws("\t", "lang", F.col("doc_id").cast("string")).alias("line")))


def grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_jobs.grep(_read(spark, sf_dir, "conversations"), "the").select("conv_id", "turn", "text")


def value_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_jobs.values_in_order(_read(spark, sf_dir, "events"), "user_id", "event_type", ["event_id"])


def columns_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declarative form: map as expressions, reduce as aggregates."""
    docs = _read(spark, sf_dir, "documents")
    return mapreduce.columns(docs, F.concat_ws("/", "source", "lang"), [F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")], where=F.length("text") > 0)


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files, and a job of functions of bytes over their lines."""
    path = new_path(spark, "file-lines")
    write_text(_read(spark, sf_dir, "documents").where(F.col("text").isNotNull()), path, "text")
    return text_jobs.distinct_lines_of_files(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "distinct_lines": _on("documents", text_jobs.distinct_lines),
    "line_count": _on("documents", text_jobs.line_count),
    "word_count": _on("documents", text_jobs.word_count),
    "inverted_index": _on("documents", text_jobs.inverted_index),
    "postings": _on("documents", text_jobs.postings),
    "grep": grep,
    "url_host_count": _on("pages", text_jobs.url_host_count),
    "reverse_links": _on("pages", text_jobs.reverse_links),
    "term_vector_per_host": _on("pages", text_jobs.term_vector_per_host),
    "sum_by_key": _on("lineitem", tables.sum_by_key),
    "reduce_side_join": _on("orders", tables.reduce_side_join, "lineitem"),
    "semi_join": _on("customer", tables.semi_join, "orders", price=PRICE),
    "anti_join": _on("customer", tables.anti_join, "orders", price=PRICE),
    "top_k": _on("orders", tables.top_k, k=100),
    "key_extract": key_extract,
    "total_sort": total_sort,
    "value_order": value_order,
    "partition_reduce": _on("documents", text_jobs.distinct_lines_by_partition),
    "combiner_parity": _on("documents", text_jobs.word_count_by_partition),
    "columns_job": columns_job,
    "events_by_hour": _on("events", tables.events_by_hour),
    "last_event_of_user": _on("events", tables.last_event_of_user),
    "ranked_brands": _on("part", tables.ranked_brands),
    "generated_lines": lambda spark, sf_dir: generated_lines(spark, 1),
    "file_lines": file_lines,
}

_LINES = "SELECT unnest(string_split(text, chr(10))) AS l FROM documents"
_TRIMMED = f"SELECT trim(l, '{WHITE_SPACE}') AS line FROM ({_LINES})"
_KEYS = f"SELECT DISTINCT split_part(line, chr(9), 1) AS key FROM ({_TRIMMED}) WHERE line <> ''"
_WORDS = "SELECT {0}, unnest(regexp_split_to_array(lower({1}), '[^a-z0-9]+')) AS word FROM {2}"
_COUNT = f"SELECT word, count(*) AS n FROM ({_WORDS.format('doc_id', 'text', 'documents')}) WHERE word <> '' GROUP BY word"

def _generated() -> str:
    """Letters of a line from its digest, as in ``generated_lines``."""
    letters = " || ".join(f"substr('{LETTERS}', ({'a' if k < 10 else 'b'} // {26 ** (k % 10)} % 26 + 1)::INTEGER, 1)" for k in range(LONGEST))
    number = "('0x' || substr(d, {}, {}))::BIGINT"
    cut = f"{number.format(1, 15)} AS a, {number.format(16, 15)} AS b, {number.format(31, 2)} % {LONGEST - SHORTEST + 1} + {SHORTEST} AS size"
    return f"SELECT substr({letters}, 1, size::INTEGER) AS value FROM (SELECT {cut} FROM (SELECT md5(i || ':0') AS d FROM range({generated_rows(1)}) t(i)))"


ORACLE_SQL: dict[str, str] = {
    "distinct_lines": _KEYS,
    "file_lines": _KEYS,
    "generated_lines": _generated(),
    "postings": f"SELECT word, doc_id // {text_jobs.BLOCK} AS block, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS docs FROM (SELECT DISTINCT doc_id, word FROM ({_WORDS.format('doc_id', 'text', 'documents')}) WHERE word <> '') GROUP BY word, block",
    "partition_reduce": _KEYS,
    "line_count": f"SELECT line, count(*) AS n FROM ({_TRIMMED}) WHERE line <> '' GROUP BY line",
    "word_count": _COUNT,
    "combiner_parity": _COUNT,
    "inverted_index": f"SELECT word, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS docs FROM (SELECT DISTINCT doc_id, word FROM ({_WORDS.format('doc_id', 'text', 'documents')}) WHERE word <> '') GROUP BY word",
    "grep": "SELECT conv_id, turn, text FROM conversations WHERE text LIKE '%the%'",
    "url_host_count": "SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1",
    "reverse_links": "SELECT target, count(*) AS pages FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) GROUP BY target",
    "term_vector_per_host": f"SELECT host, word, count(*) AS n FROM ({_WORDS.format('regexp_extract(url, $$^https?://([^/:?#]+)$$, 1) AS host', 'html', 'pages')}) WHERE word <> '' GROUP BY host, word",
    "sum_by_key": "SELECT l_returnflag AS key, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS sum_cents, count(*) AS n, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1",
    "reduce_side_join": "SELECT o_orderkey, count(l_orderkey) AS items FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "semi_join": f"SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > {PRICE})",
    "anti_join": f"SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > {PRICE})",
    "top_k": "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS price_cents FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "key_extract": "SELECT source AS key, lang || chr(9) || doc_id AS value FROM documents",
    "total_sort": "SELECT lang || chr(9) || doc_id AS line FROM documents",
    "value_order": "SELECT user_id::VARCHAR AS key, string_agg(event_type, ',' ORDER BY event_id) AS found FROM events GROUP BY user_id",
    "columns_job": "SELECT source || '/' || lang AS key, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE length(text) > 0 GROUP BY 1",
    "events_by_hour": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "last_event_of_user": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "ranked_brands": "SELECT p_brand, p_partkey, place FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS place FROM part) WHERE place <= 3",
}
