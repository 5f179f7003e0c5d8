"""Cases in which an operator once did less than its whole job."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import extract, lm, neardup, secrets
from millrace.llm.dom import parse

DOCS = "doc_id long, text string, lang string, source string, base string, size long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "b", 3) for i, t in rows], DOCS)


def test_the_model_has_words_by_the_corpus():
    """A word past the 1,022nd is learned in its own context, and all chances with those in cells sum to 1."""
    pairs = 1500
    r = np.random.default_rng(0)
    counts = {f"a{k:04}": 120 for k in range(pairs)} | {f"b{k:04}": 120 for k in range(pairs)} | {f"rare{k}": 1 for k in range(4000)}
    tokens = sum(counts.values()) + 100
    vocab = lm.Vocabulary(list(counts), list(counts.values()), tokens, len(counts) + 1, 100)
    assert vocab.own > 1022 and vocab.cells > 1
    assert lm.own_words(100 * tokens) > 9 * lm.own_words(tokens)
    assert vocab.cell_tokens.sum() + vocab.counts[: vocab.own].sum() + vocab.ends == tokens
    t = lm.Trainer(vocab.class_counts)
    place = {w.decode(): k for k, w in enumerate(vocab.words)}
    a, b = (np.array([vocab.class_of[place[f"{x}{k:04}"]] for k in range(pairs)]) for x in "ab")
    for _ in range(20):
        pick = r.integers(0, pairs, 6000)
        t.learn(np.stack([a[pick], b[pick]], axis=1).ravel())
    k = np.flatnonzero((b >= 1 + vocab.cells) & (a >= 1 + vocab.cells))[-200:]
    assert (place[f"b{k[0]:04}"]) >= 1022
    at = lambda p: t.model.log_chances(np.zeros(len(k), np.int64), a[p], b[k])
    assert at(k).mean() > at(k[::-1]).mean() + 0.5
    n = vocab.classes
    every = t.model.log_chances(np.zeros(n, np.int64), np.full(n, a[7]), np.arange(n))
    assert abs(np.exp(every).sum() - 1) < 1e-4


def test_scores_with_cells_are_a_distribution(spark):
    """Words of cells, listed or met in the join, have shares by their cell's counts."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(r.choice(words[: 1 + int(3000 * r.random() ** 3)]) for _ in range(40))) for k in range(200)]
    counts = Counter()
    for _, t in rows:
        counts.update(t.split())
    training = table(spark, rows)
    found = [lm.vocabulary(lm.word_counts(training.select("text")), 200, head)[0] for head in (1 << 17, 1)]
    for vocab in found:
        assert 1 < vocab.cells <= vocab.own < len(counts)
        assert vocab.cell_tokens.sum() + vocab.counts[: vocab.own].sum() == 8000
        assert vocab.cell_kinds.sum() + vocab.own == len(counts)
    got = lm.score(training).collect()
    assert len(got) == 200 and all(x.score < 0 for x in got)


BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def test_a_secret_after_its_name_is_found(spark):
    """NAME=value, in a line of its own, an address or an .env file: the value is a token without its name."""
    r = random.Random(8)
    keys = ["".join(r.choice(BASE64) for _ in range(46)) for _ in range(40)]
    heads = ["AWS_KEY=", "see ?sig=", "export DB_CREDENTIALS=", "a=b="]
    rows = [(k, f"{heads[k % 4]}{key}== end") for k, key in enumerate(keys)]
    found = {x.doc_id: [(m.start, m.end) for m in x.all if m.kind == 3] for x in secrets.scan(table(spark, rows)).collect()}
    at = {k: (len(heads[k % 4]), len(heads[k % 4]) + 48) for k, _ in rows}
    assert all(set(found[k]) <= {at[k]} for k in at)
    assert sum(found[k] == [at[k]] for k in at) >= 38
    clean = {x.doc_id: x.text for x in secrets.redact(table(spark, rows)).collect()}
    assert sum(clean[k] == f"{heads[k % 4]}[secret] end" for k in at) >= 38


ARTICLE = "<html><body><nav><a href='/a'>Home</a></nav><article><h1>The title of it</h1><p>First words of the text, which is long enough.</p>{}<p>Last words, which must be there too.</p></article></body></html>"
ALL = "The title of it First words of the text, which is long enough. {}Last words, which must be there too."


@pytest.mark.parametrize(
    "piece, text",
    [
        ('<svg width="1"/>', ""), ("<svg><path d='M0'/><g><title/></g></svg>", ""), ("<svg><path d='M0'><g>", ""), ("<math/>", ""), ("<math><mi>x", "x"),
        ("<video src='v'>", ""), ("<audio src='v'>", ""), ("<object data='o'>", ""), ("<canvas id='c'>", ""), ("<svg/><canvas></canvas>", ""),
        ("<p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>", "Here x=2 holds. "), ("<svg><foreignObject><div/>in it.</div></foreignObject></svg>", "in it. "),
    ],
)
def test_no_page_ends_at_an_element_left_open(piece, text):
    got = extract.trained().main_text(ARTICLE.format(piece))
    assert got == ALL.format(text and text.strip() + " ")


def test_an_open_select_keeps_what_follows():
    tree = parse(ARTICLE.format("<select><option>One<option>Two"))
    assert any("Last words" in t for t in tree.text)
    before = extract.trained().main_text("<body><svg/>" + ARTICLE.format(""))
    assert before == ALL.format("")
    raw = parse("<script>var a = '<p>'</script><svg><style>p{}</style></svg><p>x")
    assert [t for t in raw.text if t] == ["x"]


def test_tokens_of_letters_or_of_digits_are_tested(spark):
    """Random base 32 without 2-7 and decimals go through the battery; words and repeated digits don't pass it."""
    r = random.Random(9)
    keys = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(50)) for _ in range(30)] + ["".join(r.choice("0123456789") for _ in range(24)) for _ in range(30)]
    plain = ["internationalization antidisestablishmentarianism 0000000000000000000000 DONAUDAMPFSCHIFFFAHRTSGESELLSCHAFT"] * 100
    rows = [(k, f"see {t} end") for k, t in enumerate(keys)] + [(1000 + k, t) for k, t in enumerate(plain)]
    docs = table(spark, rows).select("doc_id", secrets.candidates(F.col("text")).alias("c"))
    tested = {x.doc_id: x.c for x in docs.collect()}
    assert sum(bool(tested[k]) for k in range(30)) >= 28 and sum(bool(tested[30 + k]) for k in range(30)) >= 28
    found = {x.doc_id: [m for m in x.all if m.kind == 3] for x in secrets.scan(table(spark, rows)).collect()}
    assert sum(bool(found[k]) for k in range(30)) >= 28
    assert not any(found[1000 + k] for k in range(100))


def test_different_texts_with_one_id_all_stay(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (1, a), (2, b), (3, c), (3, c + " more"), (4, a), (None, a), (5, "")]
    got = neardup.drop_near_copies(table(spark, rows), 2)
    assert got.columns == table(spark, []).columns
    assert Counter((r.doc_id, r.text[:1]) for r in got.collect()) == Counter([(1, "a"), (1, "b"), (3, "c"), (None, "a"), (5, "")])
