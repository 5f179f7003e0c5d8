"""Near-duplicates by bottom-k sketches from one hash function.

A document is its set of hashed word shingles, and its sketch is the ``K``
smallest values. Rows with equal sets are one class. Then, over classes:

1. Inverted lists. For a similarity of ``THRESHOLD`` two sketches share at
   least ``LEAST_SHARED`` values (chance of less: under 2e-7). So two linked
   classes share a value among the ``K - LEAST_SHARED + 1`` rarest of each
   sketch, by number of sketches that hold a value; only these enter lists, and
   values held by one sketch make none. Common shingles fall out by that.
2. Union-sketch filter. In a list, two classes may be linked unless their sizes
   or the estimate from the smallest values of the union of both sketches rule
   it out. What hangs together by such pairs is a cluster, so linked classes
   are in one cluster.
3. Exact Jaccard. A class's full set goes to its cluster, and pairs are
   confirmed by intersections counted over the cluster's own inverted lists.
4. Components of the links, by rounds of minimum labels.

Steps 2 and 3 search breadth first: what a class finds leaves the search, so a
group in which all are alike costs one comparison a class, and gives one edge a
class. A list or cluster that is too large for one task (``CELL`` entries, or
``CELL_BYTES`` of sets) is dealt over blocks; its most central class, the one
with the most shared values, goes to all of them. Classes that aren't tied to
it in their block are the rest, and only the rest meets all other blocks, in
cells of block pairs. So groups of near copies of any size take linear work,
nothing is capped, and no link is lost: only pairs that hang together already
are passed over. A large list or cluster whose classes are mostly not alike
still takes work that grows with the square of its size.

Sets are of 64-bit hashes; in a pair of sets of 20,000 shingles two different
shingles agree with a chance of 1e-10.

Defined results: a null text or one without words has the empty set, links
with nothing and is kept; a text with fewer words than a shingle is one
shingle; a text of any length is one set, of eight bytes a shingle, in memory;
repeated rows get equal values; rows with one id and different texts are
documents of their own, which share the id; a null id is linked with nothing
and kept; among equally central classes the one written first leads, which
changes no result; an empty table gives no rows; other columns, whatever their
names, are ignored by ``near_groups`` and kept by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import map_batches
from millrace.llm.components import ROWS_A_TASK, components
from millrace.session import ship
from millrace.storage import materialize

K = 32
LEAST_SHARED = 13
CELL = 2048
CELL_BYTES = 16 << 20
#: Lists up to this size are compared many at once, larger ones are searched breadth first.
SMALL_LIST = 8
#: Bits of the filter of ids whose sets are wanted (2 MB), and most ids that it serves; more are joined by a shuffle.
FILTER_BITS = 24
FILTER_IDS = 1 << 22
WORD_CACHE = 1 << 16
#: Most ids that are broadcast (1.6 MB); more are joined by a shuffle.
SMALL_IDS = 200_000
_M = np.uint64
_words: dict[bytes, int] = {}
EDGES = "a long, b long, v long, rest boolean"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()
    known = _words
    if len(known) > WORD_CACHE:
        known.clear()
    codes = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxh64_intdigest(w)
        codes.append(h)
    a = np.array(codes, dtype=np.uint64)
    if not len(a):
        return a
    n = min(width, len(a))
    h = _mixed(a[: len(a) - n + 1] + _M(n))
    for k in range(1, n):
        h = _mixed(h * _M(0x9E3779B97F4A7C15) + a[k : len(a) - n + 1 + k])
    return np.unique(h)


def set_key(s: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(s.tobytes())


def sketch_rows(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets), sketch."""

    def run(batch):
        sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_shingles": [len(s) for s in sets], "set_key": [set_key(s) for s in sets], "sketch": [s[:K].view(np.int64) for s in sets]}

    slim = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    return map_batches(slim, run, "doc_id long, n_shingles long, set_key binary, sketch array<long>")


def list_rows(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """v, id, blocks, weight, n, low: the entries of inverted lists with more than one class; and those of large lists alone."""
    values = reps.select("id", F.explode("sketch").alias("v"))
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = values.join(counts.hint("merge"), "v").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("found"))
    size, n = F.size("sketch"), F.col("n")
    # Whole sets of up to 26 shingles only meet whole sets, for which the bound is exact.
    least = F.when(n * 5 <= K * 4 + 2, F.ceil(n * 4 / 5)).otherwise(F.least(F.lit(LEAST_SHARED), F.ceil(n * 4 / 5)))
    room = size - least + 1 - (size - F.size("found"))
    low = F.transform("sketch", lambda x: F.shiftrightunsigned(x, 33).cast("int"))
    rarest = F.slice("found", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))
    kept = materialize(reps.join(shared.hint("merge"), "id").select("id", "n", low.alias("low"), F.size("found").alias("weight"), rarest.alias("found")), "neardup-lists")

    def entries(found: Column) -> DataFrame:
        out = kept.select("id", "n", "low", "weight", F.explode(found).alias("f"))
        return out.select(F.col("f.v").alias("v"), "id", F.ceil(F.col("f.df") / CELL).cast("int").alias("blocks"), "weight", "n", "low")

    return entries(F.col("found")), entries(F.filter("found", lambda f: f["df"] > CELL))


# --- cells: what one task searches ------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of rows with equal first ``keys`` columns, from rows in that order; many small groups come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        last = [table.column(k)[table.num_rows - 1] for k in range(keys)]
        cols = [table.column(k).combine_chunks() for k in range(keys)]
        same = np.ones(table.num_rows, dtype=bool)
        for c, x in zip(cols, last):
            same &= c.to_numpy(zero_copy_only=False) == x.as_py()
        cut = int(np.argmax(same))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table, keys: int) -> np.ndarray:
    """Where groups start and the last ends."""
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for k in range(keys):
        x = table.column(k).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def in_union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row pair of sketches: how many of the union's ``K`` smallest values are in both."""
    s = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twice = s[:, 1:] == s[:, :-1]
    place = 1 + np.cumsum(~twice, axis=1)
    return (twice & (place <= K)).sum(axis=1)


class Sketches:
    """Sizes and sketches of the entries of lists, filled up with values that no sketch has twice."""

    def __init__(self, table: pa.Table):
        self.n = table.column("n").to_numpy()
        low = table.column("low").combine_chunks()
        off = low.offsets.to_numpy()
        flat = low.values.to_numpy()[off[0] : off[-1]].view(np.uint32).astype(np.int64)
        lens = np.diff(off)
        rows = np.arange(table.num_rows)
        self.low = (1 << 40) + rows[:, None] * K + np.arange(K)
        self.low[np.repeat(rows, lens), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], lens)] = flat

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of entries may be linked."""
        x, y = self.n[a], self.n[b]
        out = np.minimum(x, y) * 100 >= np.maximum(x, y) * 80
        on = np.flatnonzero(out)
        least = np.minimum(LEAST_SHARED, np.ceil(np.minimum(x, y) * 0.8))
        for k in range(0, len(on), 1 << 14):
            p = on[k : k + (1 << 14)]
            out[p] = in_union(self.low[a[p]], self.low[b[p]]) >= least[p]
        return out

    def found(self, x: int, todo: np.ndarray) -> np.ndarray:
        return self.near(np.full(len(todo), x), todo)


class Sets:
    """The full sets of a cell, with the cell's own inverted lists of the values that two sets or more hold."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, code, count = np.unique(values, return_inverse=True, return_counts=True)
        on = count[code] > 1
        member = np.repeat(np.arange(len(sets)), self.n)[on]
        code = (np.cumsum(count > 1) - 1)[code[on]]
        self.code, self.first = code, np.searchsorted(member, np.arange(len(sets) + 1))
        self.member = member[np.argsort(code, kind="stable")]
        self.lists = np.concatenate([[0], np.cumsum(count[count > 1])])

    def found(self, x: int, todo: np.ndarray) -> np.ndarray:
        """Which of ``todo`` are linked with ``x``, by whole sets and in whole numbers."""
        own = self.code[self.first[x] : self.first[x + 1]]
        lens = self.lists[own + 1] - self.lists[own]
        inner = np.zeros(len(self.n), dtype=np.int64)
        step = max(1, int(len(own) * (1 << 22) / max(1, lens.sum())))
        for k in range(0, len(own), step):
            a, m = self.lists[own[k : k + step]], lens[k : k + step]
            at = np.repeat(a - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            inner += np.bincount(self.member[at], minlength=len(self.n))
        both = inner[todo]
        return both * 100 >= 80 * (self.n[x] + self.n[todo] - both)


def whole(found: Callable[[int, np.ndarray], np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, the first entry of what each hangs together with), searched breadth first in ``order``."""
    todo, queue, root = order, [], -1
    left, right = [order[:0]], [order[:0]]
    while len(todo) or queue:
        if not queue:
            root = int(todo[0])
            queue, todo = [root], todo[1:]
        if not len(todo):
            break
        x = queue.pop()
        keep = found(x, todo)
        got, todo = todo[keep], todo[~keep]
        queue += got.tolist()
        left.append(np.full(len(got), root))
        right.append(got)
    return np.concatenate(right), np.concatenate(left)


def across(found: Callable[[int, np.ndarray], np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that tie the rest (side 0) to each other and to others (side 1: rest, side 2: the main group)."""
    label = np.arange(len(side))
    label[side == 2] = len(side)
    a, b = [], []
    for x in np.flatnonzero(side == 0).tolist():
        todo = np.flatnonzero(label != label[x])
        got = todo[found(x, todo)]
        if len(got):
            _, one = np.unique(label[got], return_index=True)
            a += got[one].tolist()  # many of the rest may find one hub, so that stands first, as a root does
            b += [x] * len(one)
            both = np.append(label[got], label[x])
            label[np.isin(label, both)] = both.max()
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _rows(a: np.ndarray, b: np.ndarray, v: np.ndarray | None = None) -> pa.RecordBatch:
    """Edges; with v: entries ``a`` that are the rest of ``v``."""
    rest = v is not None
    cols = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(v if rest else np.zeros(len(a), np.int64), pa.int64()), pa.array(np.full(len(a), rest))]
    return pa.record_batch(cols, names=["a", "b", "v", "rest"])


def _searched(make: Callable[[pa.Table], object], first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A search of cells. Rows come sorted by v, i, j, side; side 0 is the central class or the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            ids, side, dealt, v = (table.column(c).to_numpy() for c in ("id", "side", "dealt", "v"))
            bounds = _bounds(table, 3)
            sizes = np.diff(bounds)
            left, right = [], []
            many = make(table) if make is Sketches else None
            if many is not None and first:
                for size in range(2, SMALL_LIST + 1):
                    starts = bounds[:-1][(sizes == size) & ~dealt[bounds[:-1]]]
                    if len(starts):
                        i, j = np.triu_indices(size, 1)
                        a, b = (starts[:, None] + i).ravel(), (starts[:, None] + j).ravel()
                        keep = many.near(a, b)
                        left.append(a[keep])
                        right.append(b[keep])
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if e - s < 2 or (many is not None and first and e - s <= SMALL_LIST and not dealt[s]):
                    continue
                if many is not None:
                    found = lambda x, todo, s=s: many.found(x + s, todo + s)
                else:
                    found = make(table.slice(s, e - s)).found
                if not first:
                    a, b = across(found, side[s:e])
                else:
                    b, a = whole(found, np.arange(e - s))
                    if dealt[s]:
                        off = np.ones(e - s, dtype=bool)
                        off[b[a == 0]] = False
                        off[0] = False
                        gone = np.flatnonzero(off & (ids[s:e] != ids[s])) + s
                        if len(gone):
                            yield _rows(ids[gone], ids[gone], v[gone])
                left.append(a + s)
                right.append(b + s)
            if left:
                pairs = np.unique(np.stack([ids[np.concatenate(left)], ids[np.concatenate(right)]], axis=1), axis=0)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                if len(pairs):
                    yield _rows(pairs[:, 0], pairs[:, 1])

    return run


def _full_sets(table: pa.Table) -> Sets:
    return Sets([np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("set")])


def linked(own: DataFrame, large: DataFrame, carry: list[str], make: Callable[[pa.Table], object], fill: Callable[[DataFrame], DataFrame], needs: list[str], name: str) -> DataFrame:
    """Edges (a, b) of what hangs together in each v.

    own: v, id, blocks, weight and the columns ``carry``; large: its rows with
    more than one block. ``fill`` adds to cells what ``make`` needs.
    """
    block = lambda n, salt: F.pmod(F.xxhash64("id", "v", F.lit(salt)), n).cast("int")
    more = [F.col(c) for c in ("id", *carry)]
    zero = F.lit(0)

    def searched(cells: DataFrame, first: bool) -> DataFrame:
        cells = fill(cells).select("v", "i", "j", "side", "dealt", "id", *needs)
        ordered = cells.repartition("v", "i", "j").sortWithinPartitions("v", "i", "j", "side", "id")
        return materialize(ordered.mapInArrow(_searched(make, first), EDGES), name)

    flat = own.select("v", block(F.col("blocks"), 0).alias("i"), zero.alias("j"), F.lit(1).alias("side"), (F.col("blocks") > 1).alias("dealt"), *more)
    lead = large.groupBy("v").agg(F.max(F.struct("weight", (-F.col("id")).alias("id_"), "blocks", *[F.col(c) for c in ("id", *carry)])).alias("m"))
    lead = lead.select("v", F.explode(F.sequence(zero, F.col("m.blocks") - 1)).alias("i"), zero.alias("j"), zero.alias("side"), F.lit(True).alias("dealt"), *[F.col(f"m.{c}").alias(c) for c in ("id", *carry)])
    one = searched(flat.unionByName(lead), True)
    edges, rest = one.where("not rest").select("a", "b"), one.where("rest").select("v", F.col("a").alias("id")).distinct()
    if not rest.limit(1).count():
        return edges
    rest = materialize(rest.coalesce(max(rest.sparkSession.sparkContext.defaultParallelism, -(-one.count() // ROWS_A_TASK))), f"{name}-rest")
    counts = rest.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    both = large.join(counts, "v").join(rest.withColumn("off", F.lit(True)), ["v", "id"], "left")
    side = F.when(F.col("off"), F.lit(1)).otherwise(F.lit(2))
    rows = F.transform(F.sequence(zero, F.col("parts") - 1), lambda i: F.struct(i.alias("i"), block(F.col("blocks"), 0).alias("j"), side.alias("side")))
    own_rows = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda j: F.struct(block(F.col("parts"), 1).alias("i"), j.alias("j"), zero.alias("side")))
    cell = F.explode(F.when(F.col("off"), F.concat(rows, own_rows)).otherwise(rows))
    cells = both.select("v", cell.alias("c"), F.lit(True).alias("dealt"), *more).select("v", "c.i", "c.j", "c.side", "dealt", "id", *carry)
    return edges.union(searched(cells, False).select("a", "b"))


def contracted(edges: DataFrame) -> DataFrame:
    """Edges with the same components: each ``b`` goes to its least ``a`` only, and its other ``a`` to that one.

    Lists of one group give many edges to few leaders; this leaves one a class,
    and the few among leaders.
    """
    own = edges.groupBy("b").agg(F.sort_array(F.collect_set("a")).alias("all"))
    least = F.element_at("all", 1)
    pairs = F.concat(F.array(F.struct(least.alias("a"), F.col("b").alias("b"))), F.transform(F.slice("all", 2, 1 << 30), lambda a: F.struct(least.alias("a"), a.alias("b"))))
    return own.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bits of the hashes of ids; as long for any number of ids."""
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    words = ids.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {1 << FILTER_BITS}) & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for w, bits in words.collect():
        out[w] = bits
    return out.view(np.uint64)


def set_rows(docs: DataFrame, ids: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """set_key, set of the documents in ``ids`` (and of a few others): hashed again from the text, in one scan."""
    spark = docs.sparkSession
    slim = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    few = ids.limit(FILTER_IDS + 1).count() <= FILTER_IDS
    bits = spark.sparkContext.broadcast(id_filter(ids)) if few else None
    if not few:
        slim = slim.join(ids.hint("merge"), "id", "left_semi")

    def run(batch):
        if bits is not None:
            slots = batch.column(2).to_numpy()
            on = (bits.value[slots >> 6] >> (slots & 63).astype(np.uint64)) & _M(1) == 1
            batch = batch.filter(pa.array(on))
        if not batch.num_rows:
            return None
        sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
        return {"set_key": [set_key(s) for s in sets], "set": [s.tobytes() for s in sets]}

    return map_batches(slim.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))), run, "set_key binary, set binary")


def links(docs: DataFrame, reps: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) between classes (set_key, id, doc_id, n, sketch) that give the components of all links."""
    ship(docs.sparkSession)
    own, large = list_rows(reps)
    near = linked(own, large, ["n", "low"], Sketches, lambda cells: cells, ["n", "low"], "neardup-near")
    cluster = components(contracted(near)).select("id", F.col("label").alias("v"))
    known = cluster.join(reps.select("id", "doc_id", "set_key", "n").hint("merge"), "id")
    sizes = known.groupBy("v").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CELL), F.ceil(F.sum("n") * 8 / CELL_BYTES)).cast("int").alias("blocks"))
    members = materialize(known.join(sizes, "v").select("v", "id", "blocks", F.col("n").alias("weight"), "set_key", "doc_id"), "neardup-members")
    sets = materialize(set_rows(docs, members.select(F.col("doc_id").alias("id")), width, id_col, text_col), "neardup-sets").dropDuplicates(["set_key"])
    return linked(members, members.where("blocks > 1"), ["set_key"], _full_sets, lambda cells: cells.join(sets.hint("merge"), "set_key"), ["set"], "neardup-links")


def near_groups(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows = materialize(sketch_rows(docs, width, id_col, text_col), "neardup-rows")
    real = rows.where("doc_id is not null and n_shingles > 0")
    least = real.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("r"))
    # Classes have numbers of their own: rows with one id may be in several.
    reps = materialize(least.select("set_key", F.monotonically_increasing_id().alias("id"), "r.doc_id", F.col("r.n_shingles").alias("n"), "r.sketch"), "neardup-classes")
    labels = components(links(docs, reps, width, id_col, text_col))
    known = reps.select("set_key", "id", "doc_id").join(labels, "id", "left").select("set_key", "doc_id", F.coalesce("label", "id").alias("label"))
    first = known.groupBy("label").agg(F.min("doc_id").alias("component"))
    class_ = known.join(first, "label").select("set_key", "component")
    found = rows.join(class_, "set_key", "left")
    component: Column = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept. Where ids repeat, rows are told apart by a number, in order of ids."""
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    repeated = docs.where(id_.isNotNull()).groupBy(id_).count().where("count > 1")
    if repeated.limit(1).count():
        number = F.when(id_.isNotNull(), F.monotonically_increasing_id()).alias("key")
        keyed = materialize(docs.orderBy(id_, F.xxhash64(text)).select(row, number), "neardup-numbered")
    else:
        keyed = docs.select(row, id_.alias("key"))
    own = near_groups(keyed.select("key", F.col("row").getField(text_col).alias("text")), width, "key", "text").where("not kept")
    gone = materialize(own.select(F.col("doc_id").alias("gone")).distinct(), "neardup-gone")
    few = gone.limit(SMALL_IDS + 1).count() <= SMALL_IDS
    left = keyed.join(F.broadcast(gone) if few else gone.hint("merge"), F.col("key") == F.col("gone"), "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of all documents at two-word shingles."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 2)
