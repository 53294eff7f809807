"""Similarity join of documents on word shingles with signature trees.

Sets are the distinct five-word shingles; two documents link when
100 * |A & B| >= 75 * |A | B|. Equal sets are one set from the start, named by a
64-bit digest.

1. Shingles are put in one global order, rare ones first (frequencies from a
   hashed histogram over all documents). Two sets that link share a shingle
   among the first n - ceil(0.75 n) + 1 of each, so the sets that have a
   shingle there make one signature tree for each such shingle. Of trees with
   the same sets one stays.
2. The nodes of a tree hold OR-combined bitmaps, size ranges and, for the
   collisions inside the bitmaps, the largest number of lost bits. A dual
   traversal drops pairs of nodes whose largest possible overlap is too small
   or which lie in one component already.
3. What is left is checked exactly. A traversal gives each set at most ``most``
   partners, those of the least names, so near copies meet at few centres, and
   each two components at most as many pairs. Trees where pairs were left out are
   traversed again, with a larger ``most``, after the components have been
   joined, until none is left out: no link between components is lost.

A tree of more than ``BLOCK`` sets is cut into blocks. The first rounds (one for
a tree of few blocks) look inside blocks only and join most of a large group;
then all pairs of blocks are traversed but those inside one component and those
whose sizes cannot link.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glasspane.llm import tokens
from glasspane.llm.components import components
from glasspane.llm.rows import Scratch, discard, small_batches

WORDS = 5
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
#: Least and largest number of bits of a set's bitmap; nodes have the least.
SIGNATURE_BITS, MOST_BITS = 2048, 1 << 16
#: Histogram of shingle frequencies: buckets, and buckets in one row of it.
BUCKETS = 1 << 22
SLICE = 1 << 14
#: A shingle in a bucket of so many times the median, and at least so many rows, is dealt by set too, to so many places.
HOT_TIMES, HOT_LEAST, HOT_PLACES = 64, 256, 64
#: Sets in a leaf, children of a node, sets of a block of a large tree.
LEAF, FANOUT, BLOCK = 8, 4, 1024
#: Rounds that look inside the blocks of large trees only (one where all pairs of blocks are few: up to ``GROWTH`` blocks), and what ``most`` grows by.
INSIDE, GROWTH = 3, 8
#: Bits of the filter by which documents are chosen for the exact check: of a fixed size, whatever the corpus.
CHOSEN = 67_108_859


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of rows: range, shingle rows and keys, and of the rows with words: number, first key, name."""
    for lo, hi in tokens.pieces(texts):
        row, key = tokens.shingles(tokens.words(texts.slice(lo, hi - lo), tokens.NOT_SPACE), WORDS)
        rows, first = np.unique(row, return_index=True)
        digest = np.add.reduceat(tokens.mix(key ^ np.uint64(SEEDS[0])), first) if len(first) else key
        size = np.diff(np.append(first, len(row))).astype(np.uint64)
        yield lo, hi, row, key, rows, first, _signed(tokens.mix(digest + size))


def _signatures(key: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Bitmap of each set: bit h mod width, the width a power of two of at least twice the set's size, within bounds."""
    out = []
    for lo, hi in zip(first, np.append(first[1:], len(key))):
        width = SIGNATURE_BITS
        while width < min(2 * (hi - lo), MOST_BITS):
            width *= 2
        bits = np.zeros(width, bool)
        bits[(key[lo:hi] >> np.uint64(20)).astype(np.int64) % width] = True
        out.append(np.packbits(bits).tobytes())
    return out


def _folded(blob: bytes, width: int) -> np.ndarray:
    """The bitmap at a smaller width: halves are OR-combined, since bit h mod width follows from it."""
    bits = np.frombuffer(blob, np.uint64)
    return np.bitwise_or.reduce(bits.reshape(-1, width // 64), axis=0)


def _sketch(docs: DataFrame) -> DataFrame:
    """One row for each document (kind 0) and, from each task, its part of the histogram (kind 1)."""
    schema = "kind int, doc_id long, n long, sid long, least long, bits binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for lo, hi, row, key, rows, first, sid in _sets(tokens.column(batch.column(1))):
                n = hi - lo
                np.add.at(counts, (key & np.uint64(BUCKETS - 1)).astype(np.int64), np.uint32(1))
                size = np.bincount(row, minlength=n)
                wide = np.zeros((2, n), np.int64)
                wide[0, rows] = sid
                wide[1, rows] = _signed(np.minimum.reduceat(tokens.mix(key + np.uint64(SEEDS[1])), first)) if len(first) else 0
                blobs: list = [None] * n
                for r, b in zip(rows.tolist(), _signatures(key, first)):
                    blobs[r] = b
                none = size == 0
                columns = [pa.array(np.zeros(n, np.int32)), batch.column(0).slice(lo, n), pa.array(size.astype(np.int64))]
                columns += [pa.array(w, mask=none) for w in wide]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(blobs, pa.binary())], names=names)
        parts = counts.reshape(-1, SLICE)
        used = np.flatnonzero(parts.any(axis=1))
        for i in used:
            nothing = pa.nulls(1, pa.int64())
            columns = [pa.array([1], pa.int32()), nothing, pa.array([i], pa.int64()), nothing, nothing]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([zlib.compress(parts[i].tobytes(), 1)], pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _histogram(parts: DataFrame) -> np.ndarray:
    """Rank of each bucket's frequency in quarter powers of two; of a fixed size whatever the corpus."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[i] = held.get(i, 0) + np.frombuffer(zlib.decompress(blob.as_py()), np.uint32).astype(np.uint64)
        for i, c in held.items():
            blob = np.minimum(4 * np.log2(1.0 + c), 255).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([blob], pa.binary())], names=["slice", "ranks"])

    got = parts.select(F.col("n").alias("slice"), "bits").repartition("slice").mapInArrow(run, "slice long, ranks binary")
    out = np.zeros(BUCKETS, np.uint8)
    for r in got.collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["ranks"], np.uint8)
    return out


def _postings(docs: DataFrame, sent) -> DataFrame:
    """Distinct ``shingle, place, sid`` of the first shingles of each set; ``place`` is 0 but for frequent shingles."""
    usual = float(np.median(sent.value))
    hot_from = min(255, max(usual + 4 * np.log2(HOT_TIMES), 4 * np.log2(1.0 + HOT_LEAST)))

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sent.value
        for batch in batches:
            for _, _, row, key, _, first, sids in _sets(tokens.column(batch.column(0))):
                if not len(key):
                    continue
                r = rank[(key & np.uint64(BUCKETS - 1)).astype(np.int64)]
                order = np.argsort((row << 8) | r, kind="stable")
                size = np.diff(np.append(first, len(row)))
                # copies in one slice are one set
                new = np.sort(np.unique(sids, return_index=True)[1])
                at, which = tokens.spread(first[new], (first + size - -(-75 * size // 100) + 1)[new])
                at, sid = order[at], sids[new][which]
                place = np.where(r[at] >= hot_from, 1 + (sid % HOT_PLACES), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(key[at])), pa.array(place), pa.array(sid)], names=["shingle", "place", "sid"])

    all_of = docs.select("text").mapInArrow(emit, "shingle long, place int, sid long")
    return all_of.where("shingle is not null and place is not null").repartition("shingle", "place").dropDuplicates(["shingle", "place", "sid"])


def _trees(postings: DataFrame) -> DataFrame:
    """``shingle, place, c`` of one of each group of trees with the same ``c`` members, more than one.

    Members are known by their number, least, greatest, and two sums of hashes.
    A frequent shingle has a row for each place, so that the postings need not be dealt again.
    """
    part = [F.sum(F.shiftright(F.xxhash64(F.lit(i), "sid"), 32)).alias(f"x{i}") for i in (0, 1)]
    per = postings.groupBy("shingle", "place").agg(F.count("*").alias("c"), F.min("sid").alias("lo"), F.max("sid").alias("hi"), *part)
    # frequent shingles have a row for each place; a filter on the place alone would be pushed into a second scan of the texts
    sums = [F.sum(x).alias(x) for x in ("c", "x0", "x1")]
    whole = per.where("c > 1 or place > 0").groupBy("shingle").agg(sums[0], F.max("place").alias("place"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *sums[1:]).where("c > 1")
    one = whole.groupBy("c", "lo", "hi", "x0", "x1").agg(F.min(F.struct("shingle", "place")).alias("t"))
    places = F.when(F.col("t.place") > 0, F.sequence(F.lit(1), F.lit(HOT_PLACES))).otherwise(F.array(F.lit(0)))
    return one.select("t.shingle", F.explode(places).alias("place"), "c")


class _Tree:
    """Levels of a signature tree over sets in their order; leaves come first."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, label: np.ndarray):
        lost = n - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, n, n, lost, label, label)]
        width = LEAF
        while len(self.levels[-1][1]) > 1:
            bits, lo, hi, lost, least, most = self.levels[-1]
            at = np.arange(0, len(lo), width)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(lost, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))
            width = FANOUT

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = LEAF if level == 1 else FANOUT
        return node * width, np.minimum((node + 1) * width, len(self.levels[level - 1][1]))


def _possible(one: tuple, two: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of nodes may hold two linked sets of different components."""
    bits, lo, hi, lost, least, most = one
    bits2, lo2, hi2, lost2, least2, most2 = two
    ok = (100 * hi[x] >= 75 * lo2[y]) & (100 * hi2[y] >= 75 * lo[x])
    ok &= ~((least[x] == most[x]) & (least2[y] == most2[y]) & (least[x] == least2[y]))
    at = np.flatnonzero(ok)
    for part in range(0, len(at), 4096):
        p = at[part : part + 4096]
        common = np.bitwise_count(bits[x[p]] & bits2[y[p]]).sum(axis=1) + np.minimum(lost[x[p]], lost2[y[p]])
        bound = np.minimum(common, np.minimum(hi[x[p]], hi2[y[p]]))
        ok[p] = 175 * bound >= 75 * (lo[x[p]] + lo2[y[p]])
    return ok


def _traverse(a: _Tree, b: _Tree, itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets left by the dual traversal of two trees of possibly unequal height."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        keep = _possible(a.levels[la], b.levels[lb], x, y)
        x, y = x[keep], y[keep]
        if la == lb == 0 or not len(x):
            return (x[x < y], y[x < y]) if itself else (x, y)
        down_a, down_b = la >= lb, lb >= la
        if down_a:
            x, which = tokens.spread(*a.children(la, x))
            y, la = y[which], la - 1
        if down_b:
            y, which = tokens.spread(*b.children(lb, y))
            x, lb = x[which], lb - 1
        if itself and la == lb:
            x, y = x[x <= y], y[x <= y]


def _inside(starts: np.ndarray, ends: np.ndarray, level: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Pairs left inside trees whose root is a leaf, for all of them at once; rows of the level are members."""
    member, tree = tokens.spread(starts, ends)
    y, which = tokens.spread(member + 1, ends[tree])
    x = member[which]
    keep = _possible(level, level, x, y)
    return x[keep], y[keep]


def _wide(x: np.ndarray, y: np.ndarray, n: np.ndarray, blobs: pa.Array) -> np.ndarray:
    """Which pairs may link by their own bitmaps, compared at the narrower of the two widths."""
    width = 8 * np.diff(np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1])
    narrow = np.minimum(width[x], width[y])
    ok = np.ones(len(x), bool)
    for w in np.unique(narrow[narrow > SIGNATURE_BITS]).tolist():
        step = (4 << 23) // w  # pairs for some 4 MB of bitmaps
        at = np.flatnonzero(narrow == w)
        at = at[np.argsort(x[at], kind="stable")]
        for part in (at[lo : lo + step] for lo in range(0, len(at), step)):
            used, place = np.unique(np.concatenate([x[part], y[part]]), return_inverse=True)
            bits = np.stack([_folded(blobs[i].as_py(), w) for i in used.tolist()])
            lost = n[used] - np.bitwise_count(bits).sum(axis=1)
            i, j = place[: len(part)], place[len(part) :]
            most = np.bitwise_count(bits[i] & bits[j]).sum(axis=1) + np.minimum(lost[i], lost[j])
            ok[part] = 175 * most >= 75 * (n[used[i]] + n[used[j]])
    return ok


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Place of each row, from 0, among the rows that have all keys but the first in common, in the order of the first."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys[1:]], axis=0)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return out


def _candidates(members: DataFrame) -> DataFrame:
    """``a, b`` (a < b) from ``shingle, i, j, side, most, sid, label, n, bits``, sorted by (shingle, i, j).

    A third column names, in rows of their own, the trees of which pairs were left out.
    """
    names = ["shingle", "i", "j", "side", "most", "sid", "label", "n"]

    def large(at: np.ndarray, rows: dict[str, np.ndarray], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sides = [at] if rows["i"][at[0]] == rows["j"][at[0]] else [at[rows["side"][at] == s] for s in (0, 1)]
        if not all(map(len, sides)):
            return at[:0], at[:0]
        trees = [_Tree(rows["n"][s], bits[s], rows["label"][s]) for s in sides]
        x, y = _traverse(trees[0], trees[-1], len(trees) == 1)
        return sides[0][x], sides[-1][y]

    def answer(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = {c: table.column(c).to_numpy() for c in names}
        blobs = table.column("bits")
        bits = np.stack([_folded(b.as_py(), SIGNATURE_BITS) for b in blobs])
        change = np.flatnonzero(np.any([rows[c][1:] != rows[c][:-1] for c in ("shingle", "i", "j")], axis=0)) + 1
        starts, ends = np.append(0, change), np.append(change, table.num_rows)
        leaf = (ends - starts <= LEAF) & (rows["i"][starts] == rows["j"][starts])
        lost = rows["n"] - np.bitwise_count(bits).sum(axis=1)
        found = [_inside(starts[leaf], ends[leaf], (bits, rows["n"], rows["n"], lost, rows["label"], rows["label"]))]
        found += [large(np.arange(a, b), rows, bits) for a, b in zip(starts[~leaf], ends[~leaf])]
        x, y = (np.concatenate(z) for z in zip(*found))
        may = _wide(x, y, rows["n"], blobs)
        x, y = x[may], y[may]
        if not len(x):
            return
        sid = rows["sid"]
        x, y = np.where(sid[x] < sid[y], x, y), np.where(sid[x] < sid[y], y, x)
        most, label, tree = rows["most"][y], rows["label"], np.searchsorted(starts, y, side="right")
        keep = _rank(sid[x], y) < most  # a row is a member of one tree
        one, two = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        keep[keep] = _rank(sid[x[keep]], one[keep], two[keep], tree[keep]) < most[keep]
        pairs = np.unique(np.stack([sid[x[keep]], sid[y[keep]]]), axis=1)
        left = np.unique(rows["shingle"][x[~keep]])
        none = [pa.nulls(len(left), pa.int64()), pa.nulls(pairs.shape[1], pa.int64())]
        for columns in ([pa.array(pairs[0]), pa.array(pairs[1]), none[1]], [none[0], none[0], pa.array(left)]):
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "tree"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last tree may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [np.append(held[0].column(c)[-1].as_py() if held else batch.column(c)[0].as_py(), batch.column(c).to_numpy()) for c in ("shingle", "i", "j")]
            change = np.flatnonzero(np.any([v[1:] != v[:-1] for v in key], axis=0))
            if len(change):
                whole = [*held, batch.slice(0, int(change[-1]))]
                yield from answer(pa.concat_batches(whole))
                held = []
            held.append(batch.slice(int(change[-1]) if len(change) else 0))
        if held:
            yield from answer(pa.concat_batches(held))

    return members.mapInArrow(run, "a long, b long, tree long")


def _size_class(n: str) -> Column:
    """Sets that link are in one or in neighbouring classes."""
    return F.floor(F.log(F.col(n).cast("double")) / float(np.log(4 / 3)))


def _pairs_of_blocks(large: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of large trees at all pairs of blocks that may hold links between components.

    A block has sets of one size class, and of one component where that has more
    than a block of the tree's sets.
    """
    large = large.select("shingle", "sid", "label", "most")
    own = large.groupBy("shingle", "label").agg(F.count("*").alias("of_label"))
    at = large.join(own, ["shingle", "label"]).join(sets.select("sid", "n"), "sid")
    at = at.withColumn("owner", F.when(F.col("of_label") > BLOCK, F.col("label"))).withColumn("class", _size_class("n"))
    groups = at.groupBy("shingle", "owner", "class").agg(F.count("*").alias("of_group")).withColumnsRenamed({"shingle": "_s", "owner": "_o", "class": "_c"})
    same = (F.col("shingle") == F.col("_s")) & F.col("owner").eqNullSafe(F.col("_o")) & (F.col("class") == F.col("_c"))
    at = at.join(groups, same).withColumn("part", F.pmod(F.xxhash64("sid"), F.ceil(F.col("of_group") / BLOCK)))
    at = at.withColumn("block", F.xxhash64(F.coalesce("owner", F.lit(0)), F.col("owner").isNull(), "class", "part"))
    blocks = at.groupBy("shingle", "block", "owner", "class").count()
    i, j = (blocks.select("shingle", F.col("block").alias(x), F.col("owner").alias(f"{x}_owner"), F.col("class").alias(f"{x}_class")) for x in "ij")
    pairs = i.join(j, "shingle").where("i <= j and abs(i_class - j_class) <= 1 and not (i_owner <=> j_owner and i_owner is not null)").select("shingle", "i", "j")
    ends = F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).alias("side")))
    ))
    visits = pairs.select("shingle", "i", "j", ends.alias("e")).select("shingle", "i", "j", "e.block", "e.side")
    return at.select("shingle", "block", "most", "sid", "label").join(visits, ["shingle", "block"]).select("shingle", "i", "j", "side", "most", "sid", "label")


def _most(times: int) -> Column:
    """Partners that a set may have when a tree is traversed for the ``times``-th time, from 0."""
    return F.lit(min(GROWTH**times, 1 << 30))


def _within(turn: int) -> Column:
    """Which trees are looked at inside their blocks only."""
    return F.col("c") > (BLOCK if turn == 0 else GROWTH * BLOCK) if turn < INSIDE else F.lit(False)


def _forest(members: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """Members of ``shingle, sid, label, c`` with signatures and their block or pair of blocks, sorted for the traversal."""
    zero = F.lit(0).cast("long")
    parts = [members.where(F.col("c") <= BLOCK).select("shingle", zero.alias("i"), zero.alias("j"), F.lit(0).alias("side"), _most(turn).alias("most"), "sid", "label")]
    if turn < INSIDE:
        # one set of each component; trees with other numbers of blocks cut alike, so that centres are shared
        some = members.where(_within(turn)).groupBy("shingle", "label").agg(F.min("sid").alias("sid"))
        number = some.groupBy("shingle").agg(F.pow(F.lit(2), F.ceil(F.log2(F.count("*") / BLOCK))).cast("long").alias("blocks"))
        block = F.pmod(F.xxhash64(F.lit(turn), "sid"), F.greatest("blocks", F.lit(1)))
        parts.append(some.join(number, "shingle").select("shingle", block.alias("i"), block.alias("j"), F.lit(0).alias("side"), _most(turn).alias("most"), "sid", "label"))
    if turn or not INSIDE:
        most = F.when(F.col("c") > GROWTH * BLOCK, _most(max(0, turn - INSIDE) + 1)).otherwise(_most(turn - min(1, INSIDE) + 1))
        parts.append(_pairs_of_blocks(members.where((F.col("c") > BLOCK) & ~_within(turn)).withColumn("most", most), sets))
    full = reduce(DataFrame.unionByName, parts).join(sets.select("sid", "n", "least", "bits").hint("merge"), "sid")
    full = full.select("shingle", "i", "j", "side", "most", "sid", "label", "n", _size_class("n").alias("class"), "least", "bits")
    # similar sets stand side by side, so that nodes differ
    full = full.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j", "side", "class", "least", "sid")
    return full.drop("class", "least")


def _chosen(reps: DataFrame) -> np.ndarray:
    """The ids modulo ``CHOSEN`` as a table of bits."""
    p = F.pmod("rep", F.lit(CHOSEN))
    words = reps.where("rep is not null").select((p / 32).cast("long").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (p % 32).cast("int")).alias("bit"))
    got = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(CHOSEN // 32 + 1, np.uint32)
    out[got["w"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs ``a, b`` whose sets link, by exact intersection; a set's keys travel once for each of its centres ``a``."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    sent = docs.sparkSession.sparkContext.broadcast(_chosen(ends.join(sets.select("sid", "rep"), "sid").select("rep")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            none = ids.is_null().to_numpy(zero_copy_only=False)
            at = np.mod(ids.fill_null(0).to_numpy(), CHOSEN)
            mask = none | ((sent.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool)
            if not mask.any():
                continue
            for _, _, _, key, _, first, sids in _sets(tokens.column(batch.column(1).filter(pa.array(mask)))):
                blobs = [k.tobytes() for k in np.split(key, first[1:])] if len(first) else []
                yield pa.RecordBatch.from_arrays([pa.array(sids), pa.array(blobs, pa.binary())], names=["sid", "keys"])

    keys = docs.select("doc_id", "text").mapInArrow(run, "sid long, keys binary")
    visits = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("sid"), "a", F.lit(0).alias("role")), F.struct(F.col("b").alias("sid"), "a", F.lit(1).alias("role")))).alias("v"))
    rows = visits.select("v.a", "v.role", "v.sid").distinct().hint("merge").join(keys, "sid").select("a", "role", "sid", "keys")
    rows = rows.repartition("a").sortWithinPartitions("a", "role")

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.empty(0, np.uint64)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for i, (a, role, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "role", "sid")))):
                other = np.frombuffer(batch.column("keys")[i].as_py(), np.uint64)
                if role == 0:
                    at, own = a, other
                elif a == at:
                    common = int((own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other).sum())
                    if 100 * common >= 75 * (len(own) + len(other) - common):
                        out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    links = scratch.save(rows.mapInArrow(check, "a long, b long"), "links")
    sent.destroy()
    return links


def _grown(roots: DataFrame, fresh: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, root`` after the links ``fresh(a, b)``: the components of ``roots`` that they connect become one."""
    if fresh.isEmpty():
        return roots
    a, b = (roots.select(F.col("id").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
    ends = fresh.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    links = scratch.save(ends.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    new = components(links, scratch)
    moved = roots.join(new.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    joined = scratch.save(moved.unionByName(new.join(roots.select("id"), "id", "left_anti")), "roots")
    for done in (links, new):
        discard(done)
    return joined


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``shingle, sid, label, c`` of the trees that reach into more than one component."""
    labels = roots.select(F.col("id").alias("sid"), F.col("root").alias("label"))
    mine = members.join(labels, "sid", "left").select("shingle", "sid", "c", F.coalesce("label", "sid").alias("label"))
    trees = mine.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("shingle")
    return mine.join(trees, "shingle").select("shingle", "sid", "label", "c")


def similar(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable by links, the row's own
    included. Null and empty texts and texts of white space alone have no
    shingles and link with nothing; repeated rows stay and share a component;
    rows with null doc_id take part, and their component is null only if no row
    of it has an id; an empty table gives an empty one.
    """
    docs, scratch = docs.select("doc_id", "text"), Scratch(docs.sparkSession)
    with small_batches(docs.sparkSession):
        return scratch.finish(_similar(docs, scratch), "similar")


def _similar(docs: DataFrame, scratch: Scratch) -> DataFrame:
    rows = scratch.save(_sketch(docs), "rows")
    per_row = rows.where("kind = 0").select("doc_id", "n", "sid")
    kept = [F.first(c).alias(c) for c in ("n", "least", "bits")]
    sets = scratch.save(rows.where("kind = 0 and sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), *kept), "sets")
    ranks = docs.sparkSession.sparkContext.broadcast(_histogram(rows.where("kind = 1")))
    postings = _postings(docs, ranks)
    members = scratch.save(postings.join(_trees(postings).hint("merge"), ["shingle", "place"]).select("shingle", "sid", "c"), "members")
    ranks.destroy()
    now, tested, roots = members.withColumn("label", F.col("sid")), None, None
    for turn in count():
        found = _candidates(_forest(now, sets, turn)).distinct()
        if tested is not None:
            found = found.join(tested, ["a", "b"], "left_anti")  # rows that name a tree have no pair and stay
        found = scratch.save(found, "candidates")
        pairs = found.where("a is not null").select("a", "b")
        tested = pairs if tested is None else tested.unionByName(pairs)
        fresh = _verified(pairs, sets, docs, scratch)
        joined = _grown(roots, fresh, scratch) if turn else components(fresh, scratch)
        again = found.where("tree is not null").select(F.col("tree").alias("shingle"))
        held = now.select("shingle", "sid", "c")
        rest = held.join(again, "shingle", "left_semi")
        if turn < INSIDE:  # trees that have all pairs of blocks before them stay
            rest = held.where(_within(turn)).unionByName(held.where(~_within(turn)).join(again, "shingle", "left_semi"))
        left = scratch.save(_mixed(rest, joined), "left")
        for done in (fresh, now):
            discard(done)
        if turn and joined is not roots:
            discard(roots)
        now, roots = left, joined
        if now.isEmpty():
            break
    named = sets.select("sid", "rep").join(roots.withColumnRenamed("id", "sid"), "sid", "left").select("sid", "rep", F.coalesce("root", "sid").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    named = named.join(least, "root").select("sid", "component")
    some = per_row.where("sid is not null").join(named, "sid", "left")
    rest = per_row.where("sid is null").withColumn("component", F.lit(None).cast("long"))
    found = some.unionByName(rest)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
