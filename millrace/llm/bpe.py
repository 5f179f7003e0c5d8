"""BPE encoding and decoding as streaming transducers.

Encoding. A word's symbols are read into a window. A merge list fixes how far
a symbol that is not seen yet can still change what stands before it
(``sufficient_lookahead``); tokens that end at least that far before the
window's end are stable and are emitted, the rest waits for more symbols. So a
word of any length is encoded in constant memory, and the tokens are those of
merging the whole word at once.

Why the lookahead suffices. Compare merging a window with merging the whole
word. Both start from single symbols, and both apply merges by rank. Let D be
the place up to which the two agree. D moves left only when one of them merges
(u, v) where u ends at D; it then moves by the length of u. The token that
starts at the new D has u at the end of its left spine in either run. So the
merges that move D, in order, have rising ranks and each one's right part has
the previous one's left part on its left spine. The largest total length of
left parts over such chains bounds the distance; it is found by one pass over
the merges.

A text is read in pieces of about ``PIECE`` characters, cut at white space. A
piece without any is cut where no character joins the one before, and the word
that is open there goes on in the next piece. What the transducer gives for a
short word is remembered.

Decoding reads ids as they come; it holds the bytes of a character that is not
complete and nothing more.

Defined results: a null text is the empty text, and has no tokens; repeated
rows give equal rows; of two merges with one rank the left one goes first; a
text of any length needs memory for a piece and a window besides itself (for a
run of combining marks or apostrophes, which has no place to cut, for the run);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame

from millrace.functions.text import WHITE_SPACE
from millrace.llm.arrow import map_batches

#: Characters normalised and split together, and how much further white space is looked for.
PIECE = 1 << 16
FURTHER = 1 << 10
#: Words whose tokens are remembered, and as many older ones, of so many characters at most.
CACHE = 1 << 17
SHORT = 64
NEVER = 1 << 62
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def unsettled() -> frozenset[str]:
    """Characters that Unicode versions class differently: this Python's has none, or ``regex`` another."""
    import regex

    found = []
    letter, number = regex.compile(r"\p{L}").match, regex.compile(r"\p{N}").match
    for c in map(chr, range(0x80, 0x110000)):
        kind = unicodedata.category(c)
        if kind == "Cn" or (kind[0] == "L") != bool(letter(c)) or (kind[0] == "N") != bool(number(c)):
            found.append(c)
    return frozenset(found)


def sufficient_lookahead(merges: list[tuple[str, str]], length) -> int:
    """Symbols after which nothing that follows can change a token. length: of a token, in symbols."""
    left = {}
    reach: dict[str, int] = {}
    most = 0
    for u, v in merges:
        left.setdefault(u + v, u)
        before, x = 0, v
        while x is not None:
            before = max(before, reach.get(x, 0))
            x = left.get(x)
        mine = length(u) + before
        reach[u] = max(reach.get(u, 0), mine)
        most = max(most, mine)
    return most


class Word:
    """A word on its way through a window: bytes in, tokens out as they become stable."""

    def __init__(self, coder: Transducer):
        self.coder, self.window, self.pending = coder, [], b""

    def feed(self, raw: bytes) -> list[int]:
        coder, window = self.coder, self.window
        raw = self.pending + raw
        window += map(coder.bare.__getitem__, raw[:-1])
        self.pending = raw[-1:]
        out: list[int] = []
        start = 0
        while len(window) - start >= coder.window:
            used, limit = 0, coder.window - coder.lookahead
            for t in coder.merge(window[start : start + coder.window]):
                if used + coder.size[t] > limit:
                    break
                used += coder.size[t]
                out.append(t)
            start += used
        del window[:start]
        return out

    def close(self) -> list[int]:
        """What is left, with the last byte as the word's end."""
        last = [self.coder.last[b] for b in self.pending]
        return self.coder.merge(self.window + last)


class Memory(dict):
    """Results of ``fn`` for short texts, in two generations."""

    def __init__(self, fn):
        super().__init__()
        self.fn, self.older = fn, {}

    def __missing__(self, text: str) -> tuple[int, ...]:
        found = self.older.get(text)
        if found is None:
            found = self.fn(text)
        if len(text) <= SHORT:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


class Transducer:
    """Encoder for a vocabulary file of the kind byte-level BPE with word ends."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: Bits of an id; a pair of ids, and a rank with an id, are one whole number each.
        self.bits = max(self.vocab.values()).bit_length()
        self.codes: dict[int, int] = {}
        for rank, (u, v) in enumerate(merges):
            self.codes.setdefault(self.vocab[u] << self.bits | self.vocab[v], rank << self.bits | self.vocab[u + v])
        self.symbols = byte_symbols()
        self.bare = [self.vocab[s] for s in self.symbols]
        self.last = [self.vocab[s + self.suffix] for s in self.symbols]
        cut = len(self.suffix)
        length = lambda t: len(t) - (cut if cut and t.endswith(self.suffix) else 0)
        self.lookahead = sufficient_lookahead(merges, length)
        self.window = 4 * self.lookahead + max(64, *map(length, self.vocab))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        self.size = {i: length(t) for t, i in self.vocab.items()}
        self.cut_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.letter, self.number = regex.compile(r"\p{L}").match, regex.compile(r"\p{N}").match
        self.path, self.unsettled = path, None
        self.decimal = {i: b"%d" % i for i in self.token}
        self.word_ids = Memory(self.word)

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a list of symbols, lowest rank first, leftmost first."""
        n = len(ids)
        if n < 2:
            return ids
        if n <= 64:
            get, bits, mask = self.codes.get, self.bits, (1 << self.bits) - 1
            ids = list(ids)
            pairs = [get(a << bits | b, NEVER) for a, b in zip(ids, ids[1:])]
            while pairs:
                best = min(pairs)
                if best == NEVER:
                    break
                at = pairs.index(best)
                ids[at] = new = best & mask
                del ids[at + 1], pairs[at]
                if at < len(pairs):
                    pairs[at] = get(new << bits | ids[at + 1], NEVER)
                if at:
                    pairs[at - 1] = get(ids[at - 1] << bits | new, NEVER)
            return ids
        codes, bits, mask = self.codes, self.bits, (1 << self.bits) - 1
        here, after, before = list(ids), [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0:
                m = codes.get(here[k] << bits | here[after[k]])
                if m is not None:
                    heapq.heappush(heap, (m >> bits, k, here[k], here[after[k]], m & mask))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            if here[k] != a or after[k] < 0 or here[after[k]] != b:
                continue
            gone = after[k]
            here[k], here[gone] = new, -1
            after[k] = after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [x for x in here if x >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        """Tokens of a word that is there as a whole."""
        through = Word(self)
        return (*through.feed(word.encode("utf-8")), *through.close())

    def split(self, piece: str) -> list[str]:
        """Words of a text, normalised."""
        if not piece.isascii():
            try:
                piece.encode("latin-1")
            except UnicodeEncodeError:
                self.unsettled = unsettled() if self.unsettled is None else self.unsettled
                if not self.unsettled.isdisjoint(piece):
                    return self.split_by_library(piece)
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
        return self.words(piece.lower())

    def split_by_library(self, piece: str) -> list[str]:
        """The same, by the tables of the library that the file is for."""
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.path)
        byte = {s: b for b, s in enumerate(self.symbols)}
        words = own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(piece))
        return [bytes(byte[c] for c in w).decode("utf-8") for w, _ in words]

    def _kind(self, c: str) -> str:
        return "L" if self.letter(c) else "N" if self.number(c) else "O"

    def _may_cut(self, text: str, at: int) -> bool:
        """Whether nothing before ``at`` is joined with what follows, but for a word that goes on.

        A mark or a later part of a syllable may join the character before, and
        the pattern of words looks past an apostrophe.
        """
        before, c = text[at - 1], text[at]
        if "'" in text[at - 3 : at + 1] or unicodedata.category(c)[0] == "M" or 0x1160 <= ord(c) <= 0x11FF:
            return False
        if c > "\xff" or before > "\xff":
            self.unsettled = unsettled() if self.unsettled is None else self.unsettled
            return c not in self.unsettled and before not in self.unsettled
        return True

    def pieces(self, text: str, at: int, end: int) -> Iterator[tuple[str, bool]]:
        """Pieces of ``text[at:end]``, and whether a word may go on after each."""
        while end - at > PIECE + FURTHER:
            cut = at + PIECE
            ends = [e for e in (text.find(" ", cut, cut + FURTHER), text.find("\n", cut, cut + FURTHER)) if e >= 0]
            inside = not ends
            if inside:
                while cut < end and text[cut] not in WHITE_SPACE and not self._may_cut(text, cut):
                    cut += 1
                inside = cut < end and text[cut] not in WHITE_SPACE and text[cut - 1] not in WHITE_SPACE
            else:
                cut = min(ends)
            yield text[at:cut], inside
            at = cut
        yield text[at:end], False

    def _plain(self, text: str, at: int, end: int) -> Iterator[list[int]]:
        """Tokens of a stretch without special tokens."""
        open_, kind = None, ""
        for piece, inside in self.pieces(text, at, end):
            words, out = self.split(piece), []
            if open_ is not None:
                if words and self._kind(words[0][0]) == kind and piece[0] not in WHITE_SPACE:
                    out += open_.feed(words.pop(0).encode("utf-8"))
                    if not words and inside:
                        yield out
                        continue
                out += open_.close()
                open_ = None
            last = words.pop() if inside and words and self._kind(words[-1][-1]) != "N" else None
            out += chain.from_iterable(map(self.word_ids.__getitem__, words))
            if last is not None:
                open_, kind = Word(self), self._kind(last[-1])
                out += open_.feed(last.encode("utf-8"))
            yield out
        if open_ is not None:
            yield open_.close()

    def encode(self, text: str | None) -> Iterator[list[int]]:
        """Token ids of a text, some at a time, as they become stable."""
        text = text or ""
        at = 0
        for m in self.cut_special.finditer(text):
            yield from self._plain(text, at, m.start())
            yield [self.special[m[0]]]
            at = m.end()
        yield from self._plain(text, at, len(text))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens and SHA-256 of the ids and of the text that the decoder makes of them."""
        n, ids, out, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(self)
        for some in self.encode(text):
            if some:
                ids.update((b" " if n else b"") + b" ".join(map(self.decimal.__getitem__, some)))
                n += len(some)
                out.update(decoder.feed(some).encode("utf-8"))
        out.update(decoder.close().encode("utf-8"))
        return n, ids.hexdigest(), out.hexdigest()


class Decoder:
    """Ids to text, some at a time.

    The vocabulary file names no decoder; ``plain=False`` then gives what its
    library gives: token texts joined by one space. ``plain=True`` turns word
    ends into spaces and byte symbols into bytes, and bytes into characters as
    soon as they are complete.
    """

    def __init__(self, coder: Transducer, plain: bool = False):
        self.coder, self.plain, self.first = coder, plain, True
        self.text = codecs.getincrementaldecoder("utf-8")("replace")
        self.byte = {s: b for b, s in enumerate(coder.symbols)} if plain else {}

    def feed(self, tokens: list[int]) -> str:
        if not tokens:
            return ""
        if self.plain:
            return "".join(map(self._one, tokens))
        gap, self.first = "" if self.first else " ", False
        return gap + " ".join(map(self.coder.token.__getitem__, tokens))

    def _one(self, token: int) -> str:
        t = self.coder.token[token]
        if t in self.coder.special:
            return self.text.decode(b"", True) + t
        end = bool(self.coder.suffix) and t.endswith(self.coder.suffix)
        body = t[: len(t) - len(self.coder.suffix)] if end else t
        return self.text.decode(bytes(self.byte[c] for c in body), end) + " " * end

    def close(self) -> str:
        return self.text.decode(b"", True)


_coders: dict[str, Transducer] = {}


def coder(path: str) -> Transducer:
    """The transducer of a file, made once in each process."""
    if path not in _coders:
        _coders[path] = Transducer(path)
    return _coders[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the token ids of each text."""

    def run(batch):
        ids, texts = (c.to_pylist() for c in batch.columns)
        return {"doc_id": ids, "ids": [list(chain.from_iterable(coder(path).encode(t))) for t in texts]}

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text"), run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, plain: bool = False) -> DataFrame:
    """doc_id and text from doc_id and ids."""

    def run(batch):
        out = []
        for ids in batch.column(1).to_pylist():
            d = Decoder(coder(path), plain)
            out.append(d.feed(ids or []) + d.close())
        return {"doc_id": batch.column(0), "text": out}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; tokens are hashed as they are emitted."""

    def run(batch):
        ids, texts = (c.to_pylist() for c in batch.columns)
        rows = [coder(path).digest(t) for t in texts]
        return {"doc_id": ids} | {n: [r[k] for r in rows] for k, n in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text"), run, SCHEMA)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document through the transducers of word_bpe_49k.json."""
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
