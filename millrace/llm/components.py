"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import materialize

MOST_ROUNDS = 200
#: Rows that one task of a round takes.
ROWS_A_TASK = 250_000


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each end of an edge (a, b) reaches.

    A round gives each id the least label among its neighbours (partial minima
    before the shuffle, so a hub costs no more than another id) and then the
    label of its label. Each round is written out, by as many tasks as the edges
    need, not fewer than cores; rounds stop when no label changes.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-both.count() // ROWS_A_TASK))
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")).coalesce(tasks), "labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        least = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        jumped = least.join(up, "label", "left").select("id", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        new = materialize(jumped.coalesce(tasks), "labels")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
