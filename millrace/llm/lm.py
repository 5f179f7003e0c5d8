"""Language-model scores from a log-bilinear neural model.

The model predicts a token's class from the two classes before it in its
document. The end and each of the most common words are classes of their own;
every other word, known or not, is in one of the cells of a hash, which are
classes too. Both numbers follow the corpus: ``OWN`` times the square root of
its tokens, and an eighth as many cells, so that the model grows with the input.
Classes in order of their counts are cut into groups of equal sums of square
roots of counts, as many as make groups and classes within a group cost the
same for a token. The chance of a class is that of its group times that of the
class within it; both are log-bilinear: the product of a weighted sum of the
context's vectors with the vector of the group or class, whose last place is a
bias.

Training is noise-contrastive: a batch's groups against noise groups drawn from
the counts and shared by the batch, and each class against classes drawn from
its group, whose counts are alike, with Adagrad steps, in numpy. The training
documents are dealt by a hash to parts of about ``PART`` tokens, each in the
order of the hash, so the parts are the same however the input is split. Each
part trains on all its tokens from one start and hands on the vectors that it
changed; a vector's value in the model is their mean by the number of times it
was changed, added up in the order of the parts. Scores are normalised by
matrix products, over all groups and over all classes of the token's group.
Within its cell a word has its share of counts with one added, with one share
for all unknown words of the cell, so the chances of all tokens sum to 1.

Counts of all training tokens are grouped sums. The ``HEAD`` most common words
(or the words with classes of their own, if these are more) go to every task
with their counts; the tokens of other words, a small part, meet their counts in
a join. Texts are cut into words twice: for the counts, and for a table of
classes that training and scoring read.

Defined results: a null text is the empty text and has one token, the end; a
null id is counted as the empty id, which is in training; repeated rows get
equal values; words with equal counts are taken in order of their letters, and
documents with equal hashes have equal texts; a text of any length is trained
and scored whole, in memory for its classes; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import ROWS_A_PIECE
from millrace.session import ship
from millrace.storage import materialize

#: Words with classes of their own: this times the square root of the tokens. Cells for others: this share of them.
OWN = 10
CELLS = 1 / 8
HEAD = 1 << 17
#: Length of a vector, with its bias.
WIDTH = 16
NOISE = 64
#: Noise classes for each token, from the group of its class.
NOISE_INSIDE = 2
BATCH = 2048
RATE = 0.15
#: Sums of squared gradients at the start: of vectors of classes, and of groups and weights.
FIRST, FIRST_GROUP = 0.01, 1e-4
SEED = 5
#: Tokens that one task trains on.
PART = 1 << 24
#: Rows of a table of vectors that are handed on together.
ROWS = 1 << 12
#: Tokens that are normalised together.
BLOCK = 512
#: Words whose counts a task holds before it hands them on.
HELD = 1 << 19
END, OTHER = 0, 1
LOG10 = math.log(10)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def held_out(id_: Column) -> Column:
    """Whether a row is held out: crc32 of its id as text is 2 modulo 7."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def word_counts(training: DataFrame) -> DataFrame:
    """word, c over all training texts. training: text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            done = pa.record_batch([pa.array([w.decode("utf-8") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
            held.clear()
            return done

        for batch in batches:
            for k in range(batch.num_rows):
                held.update(words_of(batch.column(0)[k].as_py()))
                if len(held) >= HELD:
                    yield out()
        yield out()

    return training.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def cell_of(words: list[bytes], cells: int) -> np.ndarray:
    """Class of each word that has none of its own."""
    return np.array([OTHER + zlib.crc32(w) % cells for w in words], dtype=np.int64)


def own_words(tokens: int) -> int:
    return math.ceil(OWN * math.sqrt(tokens))


class Vocabulary:
    """The most common words, with counts, and what is known of all others: the end is class 0, then come the cells and the words."""

    def __init__(self, words: list[str], counts: list[int], tokens: int, kinds: int, ends: int):
        order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
        self.words = [words[k].encode("utf-8") for k in order]
        self.counts = np.array([counts[k] for k in order], dtype=np.int64)
        self.tokens, self.kinds, self.ends = tokens, kinds, ends
        self.own = n = min(own_words(tokens), len(words))
        other_kinds = kinds - n - (ends > 0)
        self.cells = max(1, min(math.ceil(n * CELLS), other_kinds))
        self.classes = 1 + self.cells + n
        self.class_of = np.concatenate([np.arange(n) + 1 + self.cells, cell_of(self.words[n:], self.cells)])
        self.cell_tokens = np.bincount(self.class_of[n:] - OTHER, weights=self.counts[n:], minlength=self.cells)
        self.cell_kinds = np.bincount(self.class_of[n:] - OTHER, minlength=self.cells).astype(np.float64)
        self.unlisted = tokens - ends - int(self.counts.sum()), other_kinds - (len(words) - n)
        if self.cells == 1:
            self.add_tail([(0, *self.unlisted)])

    def add_tail(self, rows: list[tuple[int, int, int]]) -> None:
        """Adds (cell, tokens, kinds) of words that aren't in the list."""
        for cell, tokens, kinds in rows:
            self.cell_tokens[cell] += tokens
            self.cell_kinds[cell] += kinds

    @property
    def class_counts(self) -> np.ndarray:
        return np.concatenate([[self.ends], self.cell_tokens, self.counts[: self.own]]).astype(np.float64)

    index: dict[bytes, int] | None = None

    def places(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the list, -1 if it isn't there."""
        if self.index is None:
            self.index = {w: k for k, w in enumerate(self.words)}
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))


def vocabulary(counts: DataFrame, ends: int, head: int = HEAD) -> tuple[Vocabulary, int]:
    """The vocabulary, and the count from which words are in its list (at most ``head``, or the own words)."""
    step = F.floor(F.log2("c") * 16)
    bins = sorted(((int(s), int(n), int(c)) for s, n, c in counts.groupBy(step).agg(F.count(F.lit(1)), F.sum("c")).collect()), reverse=True)
    total, kinds, least = sum(b[2] for b in bins), sum(b[1] for b in bins), None
    room = max(head, own_words(total + ends))
    for s, n, _ in bins:
        if n > room:
            break
        room, least = room - n, s
    common = counts.where(step >= least).collect() if least is not None else []
    found = Vocabulary([r.word for r in common], [r.c for r in common], total + ends, kinds + (ends > 0), ends)
    least = least if least is not None else 1 << 30
    if found.cells > 1:
        cell = F.crc32(F.col("word").cast("binary")) % found.cells
        rows = counts.where(step < least).groupBy(cell.cast("int").alias("cell")).agg(F.sum("c"), F.count(F.lit(1))).collect()
        found.add_tail([tuple(r) for r in rows])
    return found, least


class Groups:
    """Classes in order of counts, cut into groups of about equal sums of the counts' square roots."""

    def __init__(self, class_counts: np.ndarray):
        n = len(class_counts)
        order = np.argsort(-class_counts, kind="stable")
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[order] = np.arange(n)
        share = (class_counts[order] + 1) / (class_counts + 1).sum()
        mass = np.sqrt(share)
        # A token costs k for its group and, cut like this, sum(mass) ** 2 / k on average inside: least at k = sum(mass).
        k = math.ceil(mass.sum())
        part = np.minimum(((np.cumsum(mass) - mass / 2) / mass.sum() * k).astype(np.int64), k - 1)
        self.edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, n]
        self.wide = np.diff(self.edges)
        group = np.repeat(np.arange(len(self.wide)), self.wide)
        self.group_of = group[self.rank]
        self.noise = np.add.reduceat(share, self.edges[:-1])
        self.inside = share / self.noise[group]


class Model:
    """Vectors of classes as contexts, of groups, of classes in the groups' order, and a weight vector for each place of the context."""

    def __init__(self, groups: Groups, parts: list[np.ndarray]):
        self.groups = groups
        self.context, self.inner, self.target, self.place = parts

    @classmethod
    def start(cls, groups: Groups, width: int = WIDTH, seed: int = SEED) -> Model:
        r = np.random.default_rng(seed)
        draw = lambda n: r.standard_normal((n, width), dtype=np.float32) * np.float32(0.1)
        context, inner, target = draw(len(groups.rank)), draw(len(groups.rank)), draw(len(groups.noise))
        context[:, -1], inner[:, -1], target[:, -1] = 0, np.log(groups.inside), np.log(groups.noise)
        return cls(groups, [context, inner, target, np.array([[0.5], [1.0]], dtype=np.float32).repeat(width, axis=1)])

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.context, self.inner, self.target, self.place]

    def predicted(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        """From the context's vectors; the last place is 1, for the bias."""
        q = one * self.place[1]
        q += two * self.place[0]
        q[:, -1] = 1
        return q

    def log_chances(self, two: np.ndarray, one: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the normalised chance of each target after classes ``two``, ``one``."""
        edges = self.groups.edges
        group, at = self.groups.group_of[target], self.groups.rank[target]
        group, order = _in_order(group)
        q, at = self.predicted(self.context[two[order]], self.context[one[order]]), at[order]
        logs = np.empty(len(target), dtype=np.float32)

        def chosen(q: np.ndarray, vectors: np.ndarray, k: np.ndarray) -> np.ndarray:
            s = q @ vectors.T
            own = s[np.arange(len(k)), k]
            with np.errstate(over="ignore", divide="ignore"):
                out = own - np.log(np.exp(s, out=s).sum(axis=1))
            if not np.isfinite(out).all():  # a score beyond what single precision can take the power of
                s = (q @ vectors.T).astype(np.float64)
                most = s.max(axis=1)
                out = own - most - np.log(np.exp(s - most[:, None]).sum(axis=1))
            return out

        for k in range(0, len(target), BLOCK):
            p = slice(k, k + BLOCK)
            logs[p] = chosen(q[p], self.target, group[p])
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist() if len(group) else []
        for lo, hi in zip(first, [*first[1:], len(group)]):
            a, b = edges[group[lo]], edges[group[lo] + 1]
            if b - a > 1:
                for k in range(lo, hi, BLOCK):
                    p = slice(k, min(k + BLOCK, hi))
                    logs[p] += chosen(q[p], self.inner[a:b], at[p] - a)
        out = np.empty(len(target))
        out[order] = logs
        return out


def _in_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x`` sorted, and where each came from: one sort of whole numbers."""
    bits = len(x).bit_length()
    both = np.sort(x << bits | np.arange(len(x)))
    return both >> bits, both & (1 << bits) - 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive estimation with Adagrad: a rate for each vector of a class, and for each number of groups and weights."""

    def __init__(self, class_counts: np.ndarray, seed: int = SEED):
        self.groups = Groups(class_counts)
        self.model = Model.start(self.groups, seed=seed)
        self.log_noise = np.log(self.groups.noise * NOISE).astype(np.float32)
        self.log_inside = np.log(NOISE_INSIDE / self.groups.wide).astype(np.float32)
        self.drawn = np.cumsum(self.groups.noise)
        n = len(self.groups.rank)
        self.sums = [np.full(n, FIRST, np.float32) for _ in range(2)]
        self.group_sums = [np.full(p.shape, FIRST_GROUP, np.float32) for p in self.model.parts[2:]]
        self.times = [np.zeros(n, dtype=np.int64) for _ in range(2)]
        self.r = np.random.default_rng(seed + 1)
        self.seen = 0

    def _vectors(self, k: int, at: np.ndarray, g: np.ndarray) -> None:
        """A step of the vectors ``at`` of table ``k``, each with the sum of its gradients."""
        at, order = _in_order(at)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        rows = at[first]
        self.times[k][rows] += np.diff(np.r_[first, len(at)])
        g = np.add.reduceat(g[order], first, axis=0)
        sums = self.sums[k][rows]
        sums += np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
        self.sums[k][rows] = sums
        g *= (np.float32(-RATE) / np.sqrt(sums))[:, None]
        table = self.model.parts[k]
        g += table[rows]
        table[rows] = g

    def _dense(self, k: int, g: np.ndarray) -> None:
        self.group_sums[k - 2] += g * g
        part = self.model.parts[k]
        part -= np.float32(RATE) * g / np.sqrt(self.group_sums[k - 2])

    def batch(self, run: np.ndarray, pick: np.ndarray) -> None:
        """One step. run: classes in a row; pick: places from 2 on that are tokens to predict."""
        m, groups = self.model, self.groups
        n, size = len(pick), np.float32(1 / len(pick))
        vectors = m.context[run[:-1]]
        target = run[pick]
        group, order = _in_order(groups.group_of[target])
        place, target = pick[order] - 2, target[order]
        q = m.predicted(vectors[:-1], vectors[1:])[place]

        # Groups: the true ones, in order, against noise that the batch shares.
        drawn = np.minimum(np.searchsorted(self.drawn, self.r.random(NOISE)), len(groups.noise) - 1)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        g_q = np.repeat(m.target[group[first]], np.diff(np.r_[first, n]), axis=0)
        g_true = _sigmoid(np.einsum("ij,ij->i", q, g_q) - self.log_noise[group]) - 1
        noise = m.target[drawn]
        away = -noise
        away[:, -1] += self.log_noise[drawn]
        g_false = q @ away.T  # the bias stands in the last place, where q is 1
        np.exp(g_false, out=g_false)
        g_false += 1
        np.reciprocal(g_false, out=g_false)
        g_q *= g_true[:, None]
        g_q += g_false @ noise
        g_target = np.zeros_like(m.target)
        np.add.at(g_target, drawn, g_false.T @ q)
        g_target[group[first]] += np.add.reduceat(g_true[:, None] * q, first, axis=0)

        # Classes within groups: the true one in row 0, noise of its group below.
        wide = groups.wide[group]
        at = np.empty((NOISE_INSIDE + 1, n), dtype=np.int64)
        at[0] = groups.rank[target]
        at[1:] = np.minimum((self.r.random((NOISE_INSIDE, n), dtype=np.float32) * wide).astype(np.int64), wide - 1) + groups.edges[group]
        inner = m.inner[at]
        g_inner = np.empty_like(inner)
        alone = wide == 1
        for k in range(NOISE_INSIDE + 1):
            g = _sigmoid(np.einsum("ij,ij->i", inner[k], q) - self.log_inside[group])
            if k == 0:
                g -= 1
            g[alone] = 0
            np.multiply(q, g[:, None], out=g_inner[k])
            inner[k] *= g[:, None]
            g_q += inner[k]

        g_q[:, -1] = 0
        g_all = np.zeros((len(run) - 2, q.shape[1]), np.float32)
        g_all[place] = g_q
        g_place = np.stack([np.einsum("ij,ij->j", g_all, vectors[:-1]), np.einsum("ij,ij->j", g_all, vectors[1:])])
        g_context = np.zeros_like(vectors)
        g_context[1:] = g_all * m.place[1]
        g_context[:-1] += g_all * m.place[0]
        self._vectors(0, run[:-1], g_context)
        self._vectors(1, at.ravel(), g_inner.reshape(-1, q.shape[1]))
        self._dense(2, g_target * size)
        self._dense(3, g_place * size)
        self.seen += n

    def learn(self, classes: np.ndarray) -> None:
        """One pass over a run of classes (documents in a row, each with its end). A document starts after two ends."""
        ends = np.flatnonzero(classes == END) + 1
        run = np.concatenate([[END, END], np.insert(classes, ends, END)])
        token = np.ones(len(run), dtype=bool)
        token[:2] = False
        token[ends + np.arange(len(ends)) + 2] = False
        with np.errstate(over="ignore"):
            for k in range(2, len(run), BATCH):
                pick = np.flatnonzero(token[k : k + BATCH]) + 2
                if len(pick):
                    self.batch(run[k - 2 : k + BATCH], pick)


def class_run(vocab: Vocabulary, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in a row: words, place of each token (-1: not listed, -2: end), class, and where each text ends."""
    words, ends = [], []
    for t in texts:
        words += words_of(t)
        ends.append(len(words) + len(ends))
    ends = np.array(ends, dtype=np.int64)
    place = np.full(len(words) + len(texts), -2, dtype=np.int64)
    inside = np.ones(len(place), dtype=bool)
    inside[ends] = False
    place[inside] = found = vocab.places(words)
    listed = vocab.class_of if len(vocab.class_of) else np.array([OTHER])
    class_ = np.where(place >= 0, listed[np.maximum(place, 0)], END)
    class_[place == -1] = cell_of([words[k] for k in np.flatnonzero(found == -1)], vocab.cells)
    return words, place, class_, ends


def train(tokens: DataFrame, vocab: Vocabulary, seed: int = SEED) -> Model:
    """The mean of the models that parts train, each on its documents. tokens: mix (a hash), classes."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(vocab)
    count = max(1, -(-vocab.tokens // PART))
    names = ["part", "block", "of", "rows", "times", "change"]

    def record(part: int, block: int, of: int, rows: np.ndarray, times: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
        cols = [pa.array([x], pa.int32()) for x in (part, block, of)] + [pa.array([x.tobytes()], pa.binary()) for x in (rows, times, change)]
        return pa.record_batch(cols, names=names)

    def changes(own: Trainer, of: int) -> Iterator[pa.RecordBatch]:
        now, start = own.model.parts, Model.start(own.groups, seed=seed).parts
        for k in range(4):
            times = own.times[k] if k < 2 else np.full(len(now[k]), own.seen)
            for at in range(0, len(times), ROWS):
                rows = np.flatnonzero(times[at : at + ROWS])
                if len(rows):
                    change = (now[k][at + rows] - start[k][at + rows]).astype(np.float16 if k < 2 else np.float32)
                    yield record(k, at // ROWS, of, rows.astype(np.int16), times[at + rows].astype(np.int64), change)

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part; a task may have several."""
        own, of = None, -1
        for batch in batches:
            parts = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if parts[lo] != of:
                    if own is not None:
                        yield from changes(own, of)
                    own, of = Trainer(shared.value.class_counts, seed), int(parts[lo])
                for k in range(lo, hi, ROWS_A_PIECE):
                    piece = batch.column(2).slice(k, min(hi - k, ROWS_A_PIECE))
                    own.learn(np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in piece]).astype(np.int64))
        if own is not None:
            yield from changes(own, of)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part and block, in the order of who made them."""
        sums, seen, now = None, None, None

        def done() -> pa.RecordBatch:
            rows = np.flatnonzero(seen)
            mean = (sums[rows] / seen[rows, None]).astype(np.float32)
            return record(*now, 0, rows.astype(np.int16), seen[rows], mean)

        for batch in batches:
            for part, block, _, rows, times, change in zip(*(c.to_pylist() for c in batch.columns)):
                rows, times = np.frombuffer(rows, np.int16), np.frombuffer(times, np.int64)
                change = np.frombuffer(change, np.float16 if part < 2 else np.float32).reshape(len(rows), -1)
                if now != (part, block):
                    if now is not None:
                        yield done()
                    now, sums, seen = (part, block), np.zeros((ROWS, change.shape[1])), np.zeros(ROWS, np.int64)
                sums[rows] += change * times[:, None].astype(np.float64)
                seen[rows] += times
        if now is not None:
            yield done()

    schema = "part int, block int, of int, rows binary, times binary, change binary"
    dealt = tokens.select(F.pmod("mix", F.lit(count)).cast("int").alias("part"), "mix", "classes")
    # As many partitions as parts, or a task would train many while others wait.
    dealt = dealt.repartitionById(count, "part").sortWithinPartitions("part", "mix", F.length("classes"))
    made = materialize(dealt.mapInArrow(trained, schema), "lm-parts")
    rows = made.repartition("part", "block").sortWithinPartitions("part", "block", "of").mapInArrow(summed, schema).collect()
    model = Trainer(vocab.class_counts, seed).model
    for r in rows:
        at = np.frombuffer(r.rows, np.int16).astype(np.int64) + r.block * ROWS
        model.parts[r.part][at] += np.frombuffer(r.change, np.float32).reshape(len(at), -1)
    return model


def token_rows(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """For each of ``docs`` (doc_id, text, held_out, mix): its classes, and what doesn't depend on the model.

    n_tokens, known and base (of words in the list); share: log10 of the shares
    of counts within cells; words and times of others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    names = ("key", "doc_id", "held_out", "mix", "n_tokens", "known", "base", "share", "words", "times", "classes")
    schema = "key long, doc_id long, held_out boolean, mix long, n_tokens long, known long, base double, share double, words array<string>, times array<int>, classes binary"
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        log_cell = np.log10(vocab.cell_tokens + vocab.cell_kinds + 1)
        log_count = np.log10(vocab.counts + 1.0) if len(vocab.counts) else np.zeros(1)
        end_log = math.log10(vocab.ends + 1)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_A_PIECE):
                piece = batch.slice(at, ROWS_A_PIECE)
                texts = piece.column(1).to_pylist()
                all_words, place, class_, ends = class_run(vocab, texts)
                starts = np.concatenate([[0], ends[:-1] + 1])
                listed = np.where(place >= 0, log_count[np.maximum(place, 0)], np.where(place == -2, end_log, 0.0))
                other = (class_ >= OTHER) & (class_ < OTHER + vocab.cells)
                share = np.zeros(len(class_))
                share[other] = np.where(place >= 0, listed, 0.0)[other] - log_cell[class_[other] - OTHER]
                sums = [np.add.reduceat(x, starts) for x in ((place != -1).astype(np.int64), listed, share)]
                words, times = [], []
                for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
                    # A text's words lie as many places earlier as there are ends before it.
                    found = Counter(all_words[s - k + x] for x in np.flatnonzero(place[s:e] == -1).tolist())
                    words.append([w.decode("utf-8") for w in found])
                    times.append(list(found.values()))
                n = len(texts)
                classes = [class_[s : e + 1].astype(np.int32).tobytes() for s, e in zip(starts, ends)]
                cols = [np.arange(key, key + n), piece.column(0), piece.column(2), piece.column(3), ends - starts + 1, *sums, words, times, classes]
                key += n
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, kinds)], names=list(names))

    return docs.select("doc_id", "text", "held_out", "mix").mapInArrow(run, schema)


def model_scores(tokens: DataFrame, model: Model) -> DataFrame:
    """``tokens`` with ``model``, log10 of the chance of a document's classes, instead of the classes and words."""
    shared = tokens.sparkSession.sparkContext.broadcast((model.groups, model.parts))
    slim = tokens.select("key", "doc_id", "held_out", "n_tokens", "known", "base", "share", "classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_A_PIECE):
                piece = batch.slice(at, ROWS_A_PIECE)
                own = [np.frombuffer(x.as_buffer(), np.int32) for x in piece.column(7)]
                class_ = np.concatenate(own).astype(np.int64)
                starts = np.concatenate([[0], np.cumsum([len(x) for x in own])[:-1]])
                # The token before a text's first is an end; so is the second one before its second.
                one = np.concatenate([[END], class_[:-1]])
                two = np.concatenate([[END, END], class_[:-2]])[: len(class_)]
                one[starts], two[starts] = END, END
                logs = model.log_chances(two, one, class_) / LOG10
                cols = [*piece.columns[:7], pa.array(np.add.reduceat(logs, starts), pa.float64())]
                yield pa.record_batch(cols, names=[*piece.schema.names[:7], "model"])

    schema = "key long, doc_id long, held_out boolean, n_tokens long, known long, base double, share double, model double"
    return slim.mapInArrow(run, schema)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    ship(docs.sparkSession)
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    slim = docs.select(id_.cast("long").alias("doc_id"), text.alias("text"), held_out(id_).alias("held_out"), F.xxhash64(F.lit(seed), id_, text).alias("mix"))
    training = slim.where("not held_out").select("text")
    counts = materialize(word_counts(training), "lm-counts")
    vocab, least = vocabulary(counts, training.count())
    rows = materialize(token_rows(slim, vocab), "lm-tokens")
    model = train(rows.where("not held_out"), vocab, seed)
    scores = model_scores(rows, model)
    rare = rows.select("key", F.explode(F.arrays_zip("words", "times")).alias("r")).select("key", F.col("r.words").alias("word"), F.col("r.times").alias("times"))
    tail = counts.where(F.floor(F.log2("c") * 16) < least)
    found = rare.join(tail, "word", "left").groupBy("key").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("more"),
    )
    base_log = math.log10(float(vocab.tokens) + float(vocab.kinds) + 1)
    more = F.coalesce("more", F.lit(0.0))
    known = F.lit(-1) if not vocab.ends else F.lit(0)
    return scores.join(found, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0)) + known).cast("long").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * base_log).alias("base_score"),
        (F.col("model") + F.col("share") + more).alias("score"),
    )


def op5_lm(spark, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of the training part."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
