"""Quality classifier by hierarchical empirical Bayes.

A logistic model over byte shares and a few measures of words and lines gives
each document a log-likelihood ratio for good text. A site's share of good
documents is the mean of its documents' chances, shrunk: hosts towards the
share of the whole corpus, paths towards their host. How hard to shrink comes
from the data, by the method of moments over all hosts (paths). A document's
chance is its own ratio times its path's odds, so a document of a site with
few rows stands mostly by itself, and its site by the corpus.

The model is fitted on at most ``FIT_ROWS`` labelled documents, those with the
least hash of their id; everything else is grouped sums over all rows. Sites
meet documents by a broadcast only if there are at most ``SMALL_SITES`` of
them, else by a shuffle join in which Spark splits large sites.

Defined results: a null text is the empty text; a null host or path is a site
of its own; with no labels, or labels of one kind, the ratio is even and all
rows are kept; repeated rows get equal values; a chance of exactly
``LEAST_CHANCE`` is kept, and labelled rows with equal hashes are taken in order
of id and label; a text of any length is measured whole, in memory for its
bytes and words; an empty table gives no rows; other columns, whatever their
names, are ignored by ``classify`` and kept as they are by ``drop_rejected``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from millrace.llm.arrow import map_batches
from millrace.storage import materialize

FIT_ROWS = 8000
SMALL_SITES = 50_000
#: A document is rejected when its chance of being good is under this.
LEAST_CHANCE = 0.5
MEASURES = 262
STRENGTH = (1.0, 10_000.0)


def measures(text: str | None) -> np.ndarray:
    """Shares of bytes, and measures of length, words and lines."""
    raw = (text or "").encode("utf-8")
    out = np.zeros(MEASURES, dtype=np.float32)
    if not raw:
        return out
    out[:256] = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw))
    words = raw.split()
    lines = raw.split(b"\n")
    n = max(1, len(words))
    kinds = set(words)
    out[256] = math.log1p(len(raw))
    out[257] = len(kinds) / n
    out[258] = len(raw) / n / 10
    out[259] = len(set(lines)) / len(lines)
    out[260] = sum(a == b for a, b in zip(words, words[1:])) / n
    out[261] = len(kinds) / math.sqrt(n)
    return out


class Logistic:
    """Ridge logistic regression by Newton steps."""

    def __init__(self, mean, scale, weight, bias, prior):
        self.mean, self.scale, self.weight, self.bias, self.prior = mean, scale, weight, bias, prior

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logistic:
        if not len(x) or y.min() == y.max():
            return cls(np.zeros(MEASURES), np.ones(MEASURES), np.zeros(MEASURES), 0.0, 0.0)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))]).astype(np.float64)
        w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient = z.T @ (p - y) + penalty * w
            curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(curve, gradient)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        share = y.mean()
        return cls(mean, scale, w[:-1], float(w[-1]), float(math.log(share / (1 - share))))

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio, held within +-12."""
        return np.clip((x - self.mean) / self.scale @ self.weight + self.bias - self.prior, -12, 12)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Logistic:
    """The model of at most ``rows`` labelled documents."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    few = known.orderBy(F.xxhash64("id"), "id", "y").limit(rows)
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(few), "id").select("text", "y", "id")

    def run(batch):
        return {"id": batch.column(2), "y": batch.column(1), "x": [measures(t).tobytes() for t in batch.column(0).to_pylist()]}

    found = map_batches(chosen, run, "id long, y int, x binary").orderBy(F.xxhash64("id"), "id", "y", "x").limit(rows).collect()
    x = np.array([np.frombuffer(r.x, np.float32) for r in found]).reshape(-1, MEASURES)
    return Logistic.fit(x, np.array([r.y for r in found], dtype=np.float64))


def scored(slim: DataFrame, model: Logistic, text: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """``slim`` with ``ratio``: one Python pass over the texts, which ``text`` finds in a batch."""

    def run(batch):
        x = np.array([measures(t) for t in text(batch).to_pylist()]).reshape(-1, MEASURES)
        return dict(zip(batch.schema.names, batch.columns)) | {"ratio": pa.array(model.ratio(x), pa.float64())}

    return map_batches(slim, run, StructType([*slim.schema.fields, StructField("ratio", DoubleType())]))


def _chance(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def _strength(groups: DataFrame, n: str, good: str, towards: Column) -> float:
    """Prior rows for shrinking groups towards a share, by the method of moments."""
    got = groups.select(n, good, towards.alias("_t")).agg(
        F.sum(F.col(n) * F.pow(F.col(good) / F.col(n) - F.col("_t"), F.lit(2.0))), F.sum(F.col("_t") * (1 - F.col("_t"))), F.sum(n), F.sum(F.pow(F.col(n), F.lit(2.0))), F.count(F.lit(1))
    ).first()
    spread, noise, rows, squares, count = got
    if not rows or count < 2:
        return STRENGTH[1]
    size = (rows - squares / rows) / (count - 1)
    between = (spread / (count - 1) - noise / count) / max(size, 1.0)
    binomial = noise / count
    if between <= 0:
        return STRENGTH[1]
    return float(min(STRENGTH[1], max(STRENGTH[0], binomial / between)))


def site_rates(slim: DataFrame, prior: float) -> DataFrame:
    """host, path, host_rate, path_rate. slim: host, path, ratio."""
    chance = _chance(F.col("ratio") + prior)
    paths = materialize(slim.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(chance).alias("good")), "quality-paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")), "quality-hosts")
    good, n = hosts.agg(F.sum("host_good"), F.sum("host_n")).first()
    share = min(0.999, max(0.001, good / n)) if n else 0.5
    k = _strength(hosts, "host_n", "host_good", F.lit(share))
    rated = hosts.withColumn("host_rate", (F.col("host_good") + k * share) / (F.col("host_n") + k))
    both = materialize(paths.join(rated.select("host", "host_rate"), paths["host"].eqNullSafe(rated["host"])).select(paths["host"], "path", "n", "good", "host_rate"), "quality-sites")
    j = _strength(both, "n", "good", F.col("host_rate"))
    rate = (F.col("good") + j * F.col("host_rate")) / (F.col("n") + j)
    return both.select("host", "path", "host_rate", F.least(F.greatest(rate, F.lit(1e-4)), F.lit(1 - 1e-4)).alias("path_rate"))


def _with_chance(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows (with host, path, ratio) with host_rate, path_rate and chance."""
    small = rates.limit(SMALL_SITES + 1).count() <= SMALL_SITES
    sites = rates.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "host_rate", "path_rate")
    on = rows["host"].eqNullSafe(sites["_h"]) & rows["path"].eqNullSafe(sites["_p"])
    joined = rows.join(F.broadcast(sites) if small else sites, on, "left").drop("_h", "_p")
    return joined.withColumn("chance", _chance(F.col("ratio") + F.log(F.col("path_rate") / (1 - F.col("path_rate")))))


def _sites(host_col: str, path_col: str) -> list[Column]:
    return [F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{path_col}`").cast("string").alias("path")]


def _judged(own: DataFrame, model: Logistic, text: Callable[[pa.RecordBatch], pa.Array], without: str) -> DataFrame:
    """``own`` (host, path, ...) without one column, with ratio, host_rate, path_rate and chance."""
    rows = materialize(scored(own, model, text).drop(without), "quality-rows")
    return _with_chance(rows, site_rates(rows.select("host", "path", "ratio"), model.prior))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, chance, keep for every row."""
    model = fit(docs, labels, id_col, text_col, label_col)
    own = docs.select(*_sites(host_col, path_col), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = _judged(own, model, lambda batch: batch.column(3), "text")
    return found.select("doc_id", F.col("ratio").alias("evidence"), "host_rate", "path_rate", "chance", (F.col("chance") >= LEAST_CHANCE).alias("keep"))


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that are not rejected, as they are: each goes along whole, in one column."""
    model = fit(docs, labels, id_col, text_col, label_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = _judged(docs.select(*_sites(host_col, path_col), row), model, lambda batch: batch.column(2).field(text_col), "")
    return found.where(F.col("chance") >= LEAST_CHANCE).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """All documents, with hosts from ``source`` and paths from ``lang``."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
