"""The battery of op4 against a plain model, planted keys and prose without any."""

import math
import random
import re
from collections import defaultdict

from millrace.llm import secrets

DOCS = "doc_id long, text string, base string, least double"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BASE32 = BASE64[:26] + "234567"


def table(spark, texts):
    return spark.createDataFrame([(k, t, "b", 0.5) for k, t in enumerate(texts)], DOCS)


def tail(z):
    return 0.30103 + 0.43429 * (0.717 * z + 0.416 * z * z) if z > 0 else 0.0


def evidence(s, alphabet, agree):
    n, size = len(s), len(alphabet)
    chi = sum(s.count(c) ** 2 for c in set(s)) * size / n - n
    uniform = tail((size * (1 + (n - 1) * agree) - n - chi) / (size * math.sqrt(2 * agree * (1 - agree))))
    at = [alphabet.index(c) for c in s]
    high = [x >= size // 2 for x in at]
    ones, effect = sum(high), 0.8 * math.sqrt(n)
    both = 2 * ones * (n - ones)
    spread = both * (both - n) / (n * n * (n - 1))
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    z_runs = (runs - 1 - both / n) / math.sqrt(spread) if spread > 0 else effect
    mean = sum(at) / n
    over = sum((x - mean) ** 2 for x in at)
    z_serial = (sum((a - mean) * (b - mean) for a, b in zip(at, at[1:])) / over + 1 / n) * math.sqrt(n) if over > 0 else effect
    return min(uniform, tail(effect - abs(z_runs)), tail(effect - abs(z_serial)))


def model(texts, fdr=0.01):
    """Random spans by text."""
    tested = []
    for k, t in enumerate(texts):
        for m in re.finditer("[A-Za-z0-9+/_-]{16,}={0,6}", t or ""):
            s = m[0].rstrip("=").replace("_", "/").replace("-", "+")
            if re.fullmatch("[0-9a-f]+|[0-9A-F]+", m[0]):
                kind = "hex", evidence(s.lower(), "0123456789abcdef", 0.15)
            elif re.fullmatch("[A-Z2-7]+=*", m[0]):
                kind = "base32", evidence(s, BASE32, 0.07)
            else:
                kind = "base64", evidence(s, BASE64, 0.065)
            tested.append((k, m.start(), m.end(), (kind[0], int(2 * math.log2(m.end() - m.start()))), kind[1]))
    groups = defaultdict(list)
    for x in tested:
        groups[x[3]].append(int(min(x[4], 64.0) * 8))
    least = {}
    for g, steps in groups.items():
        kept = [s for s in steps if math.log10(len(steps) / (sum(x >= s for x in steps) * fdr)) <= s / 8]
        if kept:
            least[g] = min(kept) / 8
    out = defaultdict(list)
    for k, a, b, g, e in tested:
        if e >= least.get(g, 1e9):
            out[k].append((a, b))
    return tested, out


#: Letters in a thousand of English text.
ENGLISH = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8, 2, 2, 1, 1)))


def word(r, lo=16, hi=34):
    return "".join(r.choices(list(ENGLISH), list(ENGLISH.values()), k=r.randint(lo, hi)))


def texts(r):
    made = [" ".join(word(r) for _ in range(6)) for _ in range(250)]
    made += [f"see {''.join(r.choice(a) for _ in range(r.choice([16, 20, 24, 32, 40, 64])))}{r.choice(['', '=', '=='])} end" for a in (BASE64, BASE32, "0123456789abcdef", "0123456789") for _ in range(30)]
    made += ["0123456789abcdef" * 3, BASE64[:26] * 2, "a" * 40, "abcdefghijklmnopqrstuvwxyz" * 2, "AbCdEfGhIjKlMnOpQrStUvWx" * 2, "x_y-z_" * 6, None, ""]
    return made


def test_spans_are_those_of_the_model(spark):
    given = texts(random.Random(3))
    _, want = model(given)
    got = {x.doc_id: [(m.start, m.end) for m in x.all if m.kind == 3] for x in secrets.scan(table(spark, given)).collect()}
    assert got == {k: want.get(k, []) for k in range(len(given))}
    assert want


def test_every_token_is_a_hypothesis(spark):
    given = texts(random.Random(4))
    tested, _ = model(given)
    found = secrets.scan(table(spark, given)).sparkSession  # the spans' table is written by scan
    docs = table(spark, given).select("doc_id", secrets.candidates(secrets.F.coalesce("text", secrets.F.lit(""))).alias("c"))
    assert found is spark and sum(len(x.c) for x in docs.collect()) == len(tested)
    assert any(e == 0 for *_, e in tested)


def test_planted_keys_without_a_base_pattern(spark):
    r = random.Random(5)
    keys = ["".join(r.choice(a) for _ in range(n)) for a, n in ((BASE64, 44), (BASE32, 52)) for _ in range(40)]
    given = [f"Take {k} as it is." for k in keys] + [" ".join(word(r) for _ in range(8)) for _ in range(300)]
    rows = {x.doc_id: x for x in secrets.scan(table(spark, given)).collect()}
    at = {k: [(m.start, m.end) for m in x.all if m.kind == 3] for k, x in rows.items()}
    assert not any(rows[k].base for k in range(80))
    for part in (range(40), range(40, 80)):
        assert sum((5, 5 + len(keys[k])) in at[k] for k in part) >= 38
    assert sum(len(at[k]) for k in range(80, 380)) <= 2


def test_prose_without_keys_has_no_finds(spark):
    r = random.Random(6)
    given = [" ".join([word(r, 3, 12), word(r), f"{word(r, 5, 9)}-{word(r, 5, 9)}-{r.randint(1, 99)}", "http://www.example.org/a/long/path/of/words"]) for _ in range(2000)]
    rows = secrets.scan(table(spark, given)).collect()
    assert sum(len(x.all) for x in rows) <= 20


def test_structure_is_not_random(spark):
    """Uniform alphabets in order, in halves or in turns fail the runs or the serial test, whatever their length."""
    given = ["0123456789abcdef" * 4, "fedcba9876543210" * 4, "".join(a + b for a, b in zip(BASE64[:32], BASE64[32:])), "".join(a + a for a in BASE64)]
    rows = secrets.scan(table(spark, given)).collect()
    assert not any(m.kind == 3 for x in rows for m in x.all)


def test_a_very_long_text_is_scanned_to_its_end(spark):
    r = random.Random(7)
    key = "".join(r.choice(BASE64) for _ in range(60))
    given = ["plain words only, " * 60_000 + f"token = {'0af3' * 8} {key}", None]
    got = {x.doc_id: x.all for x in secrets.scan(table(spark, given)).collect()}
    n = len("plain words only, ") * 60_000
    assert [(m.kind, m.start, m.end) for m in got[0]][:2] == [(0, n, n + 40), (2, n + 8, n + 40)] and got[1] == []
