"""op9's transducer and decoder on texts without white space, in bounded memory, and with a large vocabulary."""

import hashlib
import json
import random
import tracemalloc
from itertools import chain

import pytest

from millrace.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def of_library(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


ALPHABETS = ["ab", "abc'd", "a1", "é日本", "한국어글", "한", "x́y", "!?'sre", "a b", "İSΣ'", "\x1ca\x85", "'", "सि", "ab\n ", "<|endoftext|>"]


def test_pieces_without_white_space(library, monkeypatch):
    """Cut every 50 characters, where words, marks, syllables or contractions may be open."""
    monkeypatch.setattr(bpe, "PIECE", 50)
    monkeypatch.setattr(bpe, "FURTHER", 10)
    coder, r = bpe.coder(bpe.vocabulary()), random.Random(1)
    for _ in range(700):
        letters = r.choice(ALPHABETS) + r.choice(["", "", r.choice(ALPHABETS)])
        text = "".join(r.choice(letters) for _ in range(r.randint(1, 400)))
        text += r.choice(["", "", "", "<|endoftext|>" + text])
        assert coder.digest(text) == of_library(library, text), text


def test_the_query_goes_through_encoder_and_decoder(monkeypatch):
    coder = bpe.coder(bpe.vocabulary())
    text = "It's a word, and another word; " * 40
    ids = list(chain.from_iterable(coder.encode(text)))
    decoder = bpe.Decoder(coder)
    assert coder.digest(text) == (len(ids), sha(" ".join(map(str, ids))), sha(decoder.feed(ids) + decoder.close()))
    fed = []
    feed = bpe.Decoder.feed
    monkeypatch.setattr(bpe.Decoder, "feed", lambda self, tokens: fed.extend(tokens) or feed(self, tokens))
    coder.digest(text)
    assert fed == ids


def test_a_word_is_emitted_before_it_ends():
    coder = bpe.coder(bpe.vocabulary())
    word, r = bpe.Word(coder), random.Random(2)
    raw = bytes(r.choice(b"theinanor") for _ in range(6 * coder.window))
    out = [word.feed(raw[k : k + 1000]) for k in range(0, len(raw), 1000)]
    assert sum(map(bool, out)) >= 4 and len(word.window) < coder.window
    assert [*chain.from_iterable(out), *word.close()] == coder.merge([*map(coder.bare.__getitem__, raw[:-1]), coder.last[raw[-1]]])


def test_memory_does_not_grow_with_the_text():
    coder, r = bpe.coder(bpe.vocabulary()), random.Random(3)
    runs = ["".join(r.choice("theinanor") for _ in range(30)) for _ in range(200)]
    short, long = ("1".join(r.choice(runs) for _ in range(n)) for n in (20_000, 320_000))
    assert len(long) > 9_900_000 and " " not in long
    coder.digest(short)
    peaks = []
    for text in (short, long):
        tracemalloc.start()
        n = sum(map(len, coder.encode(text)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert n > len(text) / 12
    assert peaks[1] < 1.5 * peaks[0] + 1e6 and peaks[1] < 12e6


def test_decoding_in_steps_is_decoding_at_once():
    coder = bpe.coder(bpe.vocabulary())
    ids = list(chain.from_iterable(coder.encode("日本語 😀 naïve <|endoftext|> it's")))
    for plain in (False, True):
        whole, steps = bpe.Decoder(coder, plain), bpe.Decoder(coder, plain)
        assert whole.feed(ids) + whole.close() == "".join([*(steps.feed([i]) for i in ids), steps.feed([]), steps.close()])


def test_a_vocabulary_of_more_than_sixteen_bits(tmp_path):
    from tokenizers import Tokenizer

    with open(bpe.vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    symbols = bpe.byte_symbols()
    tokens = [*symbols, *(s + "</w>" for s in symbols)]
    merges = [(a, b) for a in symbols for b in symbols]
    more = [("th", "e</w>"), ("th", "er"), ("the", "re")]
    ends = [(a, b + "</w>") for a in "aeiou" for b in "nrst"]
    tokens += [a + b for a, b in [*merges, *ends]] + ["the</w>", "ther"]
    merges += [*ends, *more[:2]]
    spec["model"]["vocab"] = {t: k for k, t in enumerate(tokens)}
    spec["model"]["merges"] = [list(m) for m in merges]
    spec["added_tokens"] = [t | {"id": len(tokens) + k} for k, t in enumerate(spec["added_tokens"])]
    path = str(tmp_path / "large.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    coder, library = bpe.coder(path), Tokenizer.from_file(path)
    assert len(tokens) > 65_536 and coder.bits == 17
    for text in ("the other weather is there", "Zürich, 日本 and some more 12 words<|endoftext|>", "ab" * 3000, ""):
        assert coder.digest(text) == of_library(library, text)
