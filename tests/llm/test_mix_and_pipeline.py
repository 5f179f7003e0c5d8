"""op8's words taken from each document, and the pipeline's rows, against plain models; empty tables, long texts, files left."""

import hashlib
import os
import random
import struct
import sys
from collections import Counter, defaultdict

import xxhash

import corpus_pipeline
from millrace import storage
from millrace.llm import bpe, mixing, quality, sharding

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_dedup_and_groups import brute_components  # noqa: E402
from test_randomness import model as random_spans  # noqa: E402
from test_text_operators import base_model  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def mix_key(doc_id, text, seed=8):
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=42)
    if doc_id is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=h)
    if text is not None:
        h = xxhash.xxh64_intdigest(text.encode(), seed=h)
    return h - 2**64 if h >= 2**63 else h


def taken_by_hand(rows, block=64):
    """Words taken of each row (doc_id, text, source), slot by slot in the order of the schedule."""
    size = [len((t or "").split()) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows if s is not None}, key=str.encode) + [None] * any(s is None for _, _, s in rows)
    source_size = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    total, full, level = 1.5 * sum(size), set(), 0.0
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(2 * source_size[s] for s in full)) / sum(weight[s] for s in free) if free else level
        more = {s for s in free if weight[s] * level > 2 * source_size[s]}
        if not more:
            break
        full |= more
    target = {s: 2.0 * source_size[s] if s in full else weight[s] * level for s in names}
    edges, at = [], 0
    for s in names:
        parts = round(target[s] * 1024)
        edges.append((at, at + parts, s))
        at += parts
    slots = max(1, -(-at // (1024 * block)))
    bits = (slots - 1).bit_length()
    schedule = []
    for slot in range(1 << bits):
        point = int(format(slot, f"0{bits}b")[::-1], 2) * 1024 * block if bits else 0
        schedule += [s for a, b, s in edges if a <= point < b]
    words = defaultdict(list)
    order = sorted(range(len(rows)), key=lambda k: (mix_key(rows[k][0], rows[k][1]), rows[k][0] if rows[k][0] is not None else -(2**63), size[k]))
    for k in order:
        words[rows[k][2]] += [k] * size[k]
    used, taken = Counter(), Counter()
    for s in schedule:
        blocks = -(-len(words[s]) // block)
        if used[s] < 2 * blocks:
            k = used[s] % blocks
            taken.update(words[s][k * block : (k + 1) * block])
            used[s] += 1
    return [taken[k] for k in range(len(rows))], size


def mixed_rows(n=260):
    r = random.Random(9)
    rows = [(k, " ".join(f"w{r.randint(0, 99)}" for _ in range(r.choice([0, 1, 5, 40, 130, 300]))), f"s{k % 4}" if k % 3 else "hot") for k in range(n)]
    return rows + [(1000, None, None), (1001, "a few words of no source " * 9, None), (1002, "", "s1")]


def test_words_taken_are_those_of_the_schedule(spark):
    rows = mixed_rows()
    want, size = taken_by_hand(rows)
    df = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOCS)
    got = {r.doc_id: r.taken for r in mixing.taken_words(df).collect()}
    assert got == {r[0]: n for r, n in zip(rows, want)}
    copies = Counter(r.doc_id for r in mixing.mix_documents(df).collect())
    assert copies == Counter({r[0]: (2 * n + s) // (2 * s) if s else 1 for r, n, s in zip(rows, want, size)})


def test_mix_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(k, "some words here " * 30, "s", k * 2, k * 3, f"r{k}", k / 2) for k in range(20)], "doc_id long, text string, source string, number long, copies long, row string, `a.b` double")
    got = mixing.mix_documents(df)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} <= {tuple(r) for r in df.collect()}


def test_very_long_texts_in_groups_and_mixes(spark):
    long = "word " * 400_000
    df = spark.createDataFrame([(1, long, "en", "a", 1), (2, "short one", "en", "a", 1), (3, "other " * 50, "en", "b", 1)], DOCS)
    got = {r.doc_id: r for r in mixing.taken_words(df).collect()}
    assert got[1].size == 400_000 and got[1].taken <= 800_000
    assert {r.doc_id: r.size for r in sharding.shard_documents(df, 4).collect()}[1] == 2_000_001


def write(spark, path, rows, labels):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def documents():
    r = random.Random(12)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))
    prose = [" ".join(word() for _ in range(r.randint(30, 90))) + "." for _ in range(70)]
    rows = [(k, t, "en", f"s{k % 5}", len(t)) for k, t in enumerate(prose)]
    bad = [" ".join(word() + r.choice(["%%%", "###", "$$$"]) for _ in range(40)) for _ in range(20)]
    rows += [(200 + k, t, "en", f"s{k % 5}", len(t)) for k, t in enumerate(bad)]
    rows += [(300 + k, prose[k] if k % 2 else prose[k] + " and one more word", "en", "s1", 1) for k in range(20)]
    rows += [(400 + k, f"{prose[k]} token = '{'%016x' % (k * 7919 + 2**60)}' AKIA{'ABCDEFGH12345678'} {prose[-k]}", "en", "s2", 1) for k in range(1, 8)]
    return rows, [(i, 0 if 200 <= i < 300 else 1, 0) for i, *_ in rows if i % 2]


def test_pipeline_against_models_of_its_stages(spark, tmp_path):
    rows, labels = documents()
    write(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    keep = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("keep").collect()}
    left = [x for x in rows if x[0] in keep]
    assert {200 + k for k in range(20)}.isdisjoint(keep) and len(left) > 80
    first = {i: c for i, (_, c) in brute_components([x[:2] for x in left], 5).items()}
    left = [x for x in left if first[x[0]] == x[0]]
    assert len(left) < len(keep)
    _, found = random_spans([x[1] for x in left])
    clean = []
    for k, (i, t, _, source, _) in enumerate(left):
        out, at = "", 0
        for a, b in sorted([(a, b) for a, _, b in base_model(t)] + found.get(k, [])):
            if a >= at:
                out += t[at:a] + "[secret]"
            at = max(at, b)
        clean.append((i, out + t[at:], source))
    assert any("[secret]" in t for _, t, _ in clean)
    taken, size = taken_by_hand(clean)
    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(bpe.vocabulary()), Counter()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for (i, t, _), n, s in zip(clean, taken, size):
        ids = library.encode(t, add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += (2 * n + s) // (2 * s) if s else 1
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == +want


def folders(spark):
    at = storage.shared_dir(spark).removeprefix("file://") + "/millrace"
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_only_the_last_table_is_left(spark, tmp_path):
    rows, labels = documents()
    write(spark, tmp_path, rows, labels)
    before = folders(spark)
    got = corpus_pipeline.run(spark, str(tmp_path))
    new = folders(spark) - before
    assert len(new) == 1 and next(iter(new)).startswith("stage-bpe") and got.count() > 0


def test_pipeline_in_a_folder_without_scheme(spark, tmp_path, monkeypatch):
    rows, labels = documents()
    write(spark, tmp_path, rows, labels)
    want = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(storage, "shared_dir", lambda _: f"{tmp_path}/shared")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert want and Counter(map(tuple, got.collect())) == want
    assert [x[:9] for x in os.listdir(tmp_path / "shared" / "millrace")] == ["stage-bpe"]


def test_a_stage_deletes_what_the_one_before_left_but_not_what_it_reads(spark, tmp_path):
    rows, labels = documents()
    write(spark, tmp_path, rows, labels)
    before = folders(spark)
    good = corpus_pipeline.keep_good(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    corpus_pipeline.redact_secrets(spark, good, str(tmp_path)).write.parquet(f"{tmp_path}/unwritten")
    assert any(x.startswith("quality-rows") for x in folders(spark) - before)
    written = spark.read.parquet(f"{tmp_path}/unwritten")
    corpus_pipeline.to_tokens(spark, written, str(tmp_path)).count()
    assert not any(x.startswith(("quality-", "secret-")) for x in folders(spark) - before)


def test_pipeline_on_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
