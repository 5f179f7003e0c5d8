"""op5's score against sums over all classes by hand; the same however the input is split; contexts end with their document."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import lm

DOCS = "doc_id long, text string, key long, share double"


def rows_of(n=160):
    r = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    text = lambda: " ".join(r.choice(words[: 1 + int(40 * r.random() ** 2)]) for _ in range(r.randint(0, 30)))
    rows = [(k, text()) for k in range(n)]
    return rows + [(900, None), (901, "Unseen words w1"), (902, rows[5][1]), (5, rows[5][1]), (903, "")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 0.5) for i, t in rows], DOCS)


def by_hand(rows, vocab, model):
    """log10 of each text's chance, class by class."""
    groups = model.groups
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in lm.words_of(t))
    place = {w: k for k, w in enumerate(vocab.words)}

    def class_of(w):
        k = place.get(w, -1)
        return 1 + vocab.cells + k if 0 <= k < vocab.own else 1 + zlib.crc32(w) % vocab.cells

    def chance(two, one, c):
        q = model.place[0] * model.context[two] + model.place[1] * model.context[one]
        q[-1] = 1
        scores = [math.exp(float(q @ v)) for v in model.target]
        g, at = int(groups.group_of[c]), int(groups.rank[c])
        a, b = int(groups.edges[g]), int(groups.edges[g + 1])
        inner = [math.exp(float(q @ v)) for v in model.inner[a:b]]
        return scores[g] / sum(scores) * inner[at - a] / sum(inner)

    out = {}
    for i, t in rows:
        two = one = lm.END
        total = 0.0
        for w in [*lm.words_of(t), None]:
            c = lm.END if w is None else class_of(w)
            total += math.log10(chance(two, one, c))
            if 1 <= c <= vocab.cells:
                total += math.log10((counts[w] + 1) / (vocab.cell_tokens[c - 1] + vocab.cell_kinds[c - 1] + 1))
            two, one = one, c
        out[i] = total
    return out


def test_scores_are_those_by_hand(spark, monkeypatch):
    monkeypatch.setattr(lm, "OWN", 0.3)
    monkeypatch.setattr(lm, "PART", 600)
    rows, kept = rows_of(), []
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda tokens, vocab, seed: kept.append((vocab, train(tokens, vocab, seed))) or kept[-1][1])
    got = {r.doc_id: r.score for r in lm.score(table(spark, rows)).collect()}
    vocab, model = kept[0]
    assert 1 < vocab.cells and vocab.own < 40 and vocab.tokens > 2 * 600
    want = by_hand(rows, vocab, model)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=2e-3), i


def test_splits_of_the_input_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART", 500)
    df = table(spark, rows_of())
    a, b = (sorted((r.doc_id, round(r.score, 6)) for r in lm.score(d).collect()) for d in (df.coalesce(1), df.repartition(8)))
    assert a == b


def test_a_document_starts_after_two_ends():
    seen = []

    class Noted(lm.Trainer):
        def batch(self, run, pick):
            seen.extend((int(run[k - 2]), int(run[k - 1]), int(run[k])) for k in pick)

    Noted(np.array([4.0, 3.0, 2.0, 1.0])).learn(np.array([1, 2, 0, 3, 0, 0, 2, 0]))
    assert seen == [(0, 0, 1), (0, 1, 2), (1, 2, 0), (0, 0, 3), (0, 3, 0), (0, 0, 0), (0, 0, 2), (0, 2, 0)]


def test_pairs_are_learned_within_a_few_passes():
    """A word that follows one word only gets most of the chance there."""
    r = np.random.default_rng(1)
    counts = np.full(201, 50.0)
    t = lm.Trainer(counts)
    pairs = r.permutation(np.repeat(np.arange(1, 101), 200))
    t.learn(np.stack([pairs, pairs + 100, np.zeros_like(pairs)], axis=1).ravel())
    k = np.arange(1, 101)
    assert t.model.log_chances(np.zeros_like(k), k, k + 100).mean() > math.log(0.3)


def test_a_very_long_text(spark):
    long = " ".join(f"w{k % 700}" for k in range(200_000))
    got = {r.doc_id: r for r in lm.score(table(spark, [(0, long), (1, "w1 w2"), (3, long)])).collect()}
    assert got[0].n_tokens == 200_001 and math.isfinite(got[0].score) and got[0].score == pytest.approx(got[3].score, rel=1e-6)
