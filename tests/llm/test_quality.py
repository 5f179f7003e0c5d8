"""op2: columns as they are, whatever their names, and the whole result against a plain model."""

import math
import random

import numpy as np
import pytest

from millrace.llm import quality


def prose(r, bad=False):
    w = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 60))]
    return " ".join(x + r.choice(["%%%", "###", "$$$"]) for x in w) if bad and r.random() < 0.8 else " ".join(w) + "."


def rows_of(n=300):
    r = random.Random(2)
    truth = {k: k % 3 != 0 for k in range(n)}
    return truth, [(k, prose(r, not good), r.choice(["en", "de", None]), f"h{r.randint(0, 5)}" if k % 11 else None) for k, good in truth.items()]


def labels_of(spark, truth):
    return spark.createDataFrame([(k, int(v)) for k, v in truth.items() if k % 2], "doc_id long, quality int")


def test_all_columns_keep_their_values(spark):
    truth, rows = rows_of()
    more = "chance double, host_rate string, _host long, _path string, _ratio double, ratio int, host string, path long, row string, `a.b` string, t timestamp, s struct<x:int,`y z`:string>"
    import datetime

    given = [(*x, x[0] / 7, f"r{x[0]}", x[0], "p", 0.5, 3, "mine", 9, "row", "dot", datetime.datetime(2024, 1, 1, x[0] % 24), (x[0], "é")) for x in rows]
    df = spark.createDataFrame(given, f"doc_id long, text string, lang string, source string, {more}")
    got = quality.drop_rejected(df, labels_of(spark, truth))
    assert got.columns == df.columns and got.dtypes == df.dtypes
    kept = {r.doc_id for r in quality.classify(df, labels_of(spark, truth)).where("keep").collect()}
    assert 0 < len(kept) < len(rows)
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in df.collect() if r.doc_id in kept)


def strength(groups):
    """Prior rows, from (rows, good, towards)."""
    n = sum(g[0] for g in groups)
    if len(groups) < 2:
        return 10_000.0
    spread = sum(a * (g / a - t) ** 2 for a, g, t in groups)
    noise = sum(t * (1 - t) for _, _, t in groups)
    size = (n - sum(a * a for a, _, _ in groups) / n) / (len(groups) - 1)
    between = (spread / (len(groups) - 1) - noise / len(groups)) / max(size, 1.0)
    return 10_000.0 if between <= 0 else min(10_000.0, max(1.0, noise / len(groups) / between))


def test_classify_against_a_plain_model(spark):
    truth, rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.classify(df, labels_of(spark, truth)).collect()}
    known = [x for x in rows if x[0] % 2]
    model = quality.Logistic.fit(np.array([quality.measures(x[1]) for x in known]), np.array([float(truth[x[0]]) for x in known]))
    ratio = {x[0]: float(model.ratio(quality.measures(x[1])[None])[0]) for x in rows}
    chance = lambda z: 1 / (1 + math.exp(-z))
    good = {i: chance(z + model.prior) for i, z in ratio.items()}
    by = lambda key: {k: [x[0] for x in rows if key(x) == k] for k in {key(x) for x in rows}}
    hosts, paths = by(lambda x: x[3]), by(lambda x: (x[3], x[2]))
    share = sum(good.values()) / len(good)
    k = strength([(len(ids), sum(good[i] for i in ids), share) for ids in hosts.values()])
    host_rate = {h: (sum(good[i] for i in ids) + k * share) / (len(ids) + k) for h, ids in hosts.items()}
    j = strength([(len(ids), sum(good[i] for i in ids), host_rate[h]) for (h, _), ids in paths.items()])
    path_rate = {p: (sum(good[i] for i in ids) + j * host_rate[p[0]]) / (len(ids) + j) for p, ids in paths.items()}
    for i, _, lang, source in rows:
        rate = min(1 - 1e-4, max(1e-4, path_rate[source, lang]))
        want = chance(ratio[i] + math.log(rate / (1 - rate)))
        assert got[i].evidence == pytest.approx(ratio[i], abs=1e-3)
        assert got[i].host_rate == pytest.approx(host_rate[source], abs=1e-4) and got[i].path_rate == pytest.approx(rate, abs=1e-4)
        assert got[i].chance == pytest.approx(want, abs=1e-3) and got[i].keep == (got[i].chance >= 0.5)


def test_a_very_long_text(spark):
    truth, rows = rows_of(60)
    long = "several words that go on and on " * 100_000
    df = spark.createDataFrame([*rows, (999, long, "en", "h1"), (998, None, "en", "h1")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.evidence for r in quality.classify(df, labels_of(spark, truth)).collect()}
    assert len(got) == 62 and abs(got[999]) <= 12
