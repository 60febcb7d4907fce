"""Near duplicates: prefix-tree (trie) join of n-gram sets under a Jaccard threshold.

The result is exact for sets of 64-bit n-gram hashes, at any threshold.

1. One pass writes each document's set signature (128 bits) and size, and sums a
   fixed-size count sketch of all n-grams.  Sketch count, then hash, is the
   *global order* of n-grams, rare ones first; any order gives right results, a
   good one gives short candidate lists.  Documents of equal sets are one *class
   representative* from here on, and only its text is read again.
2. Two sets of Jaccard t share an n-gram within the first |s| - ceil(t|s|) + 1
   of each (prefix filter).  A second pass emits these n-grams; one shuffle
   brings equal ones together in *cells*.  N-grams that the sketch calls frequent
   are spread over tasks instead, so no task gets more than the sketch allows.
3. Cells of up to ``small_cell`` sets give pairs; a pair stays if its common
   prefix n-grams and the rests of both sets can reach the needed overlap
   (remaining-length bound).  Larger cells aren't enumerated: all their sets go
   to the block of the cell's first set.  A pair goes to a block too: that of the
   first set of its cells.  Any pair over the threshold meets in some block.
4. Blocks over ``BLOCK_SETS`` sets or ``BLOCK_GRAMS`` n-grams are cut into shards, and
   each two shards, and each one with itself, are a task of bounded size.
5. In each task the sets are stored in a trie, the n-grams that most of them have
   first.  Sets walk it together: what a path adds to each one's overlap is found once
   for all sets below.  A set leaves a subtree that its remaining length can't bring to
   the needed overlap, and a subtree whose sets all have it is taken whole.  Links
   are counted and joined to groups there; no list of pairs leaves a task.  Of the blocks
   in which two sets meet, the first one counts their link.
6. Groups of all tasks are united by minimum labels.

No stage collects documents.  What is broadcast is of fixed size: the sketch
(8 MB) and Bloom filters (at most 64 MB) that spare building sets of documents
without candidates; an exact join follows each filter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .common import KEY, by_key, discard, frugal, keys, may_be_among, split, table, whole_id, without, written

N, THRESHOLD, SMALL_CELL = 3, 0.5, 64
SKETCH_BITS, BLOCK = 23, 1 << 17
#: Step of the sketch (see ``_steps``) from which an n-gram counts as frequent: 1,024 documents.
FREQUENT = 140
#: Sets and n-grams of a shard of a block.
BLOCK_SETS, BLOCK_GRAMS = 1024, 1 << 21
SPREAD = 256
#: Words of 64 bits of a set's most frequent items in a task.
DENSE = 64


def _sets(batch: pa.RecordBatch, n: int, rows: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, bounds, n-grams): the n-gram set of row k is grams[bounds[k]:bounds[k + 1]], ascending; rows without words are left out."""
    col = batch.column(batch.schema.get_field_index("text"))
    index = np.arange(len(col)) if rows is None else rows
    if rows is not None:
        col = col.take(pa.array(rows))
    data, off = B.buffers(col)
    for a, b in B.pieces(off):
        h, _, _, row = B.words(data[off[a] : off[b]], off[a : b + 1] - off[a])
        g, _, row = B.ngrams(h, row, n)
        g, row = B.distinct_grams(g, row)
        if len(g):
            bounds = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True])
            yield index[a + row[bounds[:-1]]], bounds, g


def signatures(bounds: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set."""
    one = np.add.reduceat(B.mix(g.copy()), bounds[:-1]).astype(np.int64)
    return one, np.add.reduceat(B.mix(g ^ np.uint64(0xD1B54A32D192ED03)), bounds[:-1]).astype(np.int64)


def _names(sums: tuple[np.ndarray, np.ndarray], clashing: np.ndarray) -> np.ndarray:
    """The number by which a set travels: the first sum, mixed with the second where two sets have the same first one."""
    return np.where(np.isin(sums[0], clashing), sums[0] ^ sums[1], sums[0]) if len(clashing) else sums[0]


def _prefix(size: np.ndarray, t: float) -> np.ndarray:
    """Length of the prefix that sets of Jaccard t or more share something of."""
    return size - np.ceil(size * t - 1e-9).astype(np.int64) + 1


def _needed(t: float, total: np.ndarray) -> np.ndarray:
    """The overlap of two sets of Jaccard t, by the sum of their sizes."""
    return np.maximum(1, np.ceil(t / (1 + t) * total - 1e-9))


def _first_pass(n: int):
    names = [*KEY, "sig", "sig2", "size", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        for batch in batches:
            for rows, bounds, g in _sets(batch, n):
                np.add.at(sketch, (g & mask).astype(np.int64), np.int32(1))
                m, at = len(rows), pa.array(rows)
                yield pa.record_batch([*(batch.column(k).take(at) for k in range(3)), *map(pa.array, signatures(bounds, g)), pa.array(np.diff(bounds)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], names)
        full = [k for k in range(len(sketch) // BLOCK) if sketch[k * BLOCK : (k + 1) * BLOCK].any()]
        if full:
            none = pa.nulls(len(full), pa.int64())
            yield pa.record_batch([none] * 6 + [pa.array(full, pa.int64()), pa.array([zlib.compress(sketch[k * BLOCK : (k + 1) * BLOCK].tobytes(), 1) for k in full], pa.binary())], names)

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in by_key(batches, "block"):
        total: dict[int, np.ndarray] = {}
        for k, c in zip(t["block"].to_pylist(), t["counts"].to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(c), np.int32)
            total[k] = total[k] + x if k in total else x.astype(np.int64)
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array([_steps(x).tobytes() for x in total.values()], pa.binary())], ["block", "counts"])


def _steps(count: np.ndarray) -> np.ndarray:
    """Counts on a scale of 256 steps, exact below 128."""
    return np.where(count < 128, count, np.minimum(255, 128 + 4 * np.log2(np.maximum(count, 128) / 128))).astype(np.uint8)


def _second_pass(n: int, t: float, sketch, clashing: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(sketch.value, np.uint8)
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        for batch in batches:
            for _, bounds, g in _sets(batch, n):
                size = np.diff(bounds)
                sig = _names(signatures(bounds, g), clashing)
                row = np.repeat(np.arange(len(size)), size)
                step = counts[(g & mask).astype(np.int64)]
                order = np.argsort((row << 32) | step, kind="stable")
                at = np.arange(len(g)) - np.repeat(bounds[:-1], size)
                pick = at < np.repeat(_prefix(size, t), size)
                row = row[pick]
                spread = np.where(step[order][pick] >= FREQUENT, 1 + (sig[row] & (SPREAD - 1)), 0)
                yield pa.record_batch([pa.array(g[order][pick].view(np.int64)), pa.array(spread.astype(np.int32)), pa.array(sig[row]), pa.array(size[row].astype(np.int32)), pa.array(at[pick].astype(np.int32))], ["gram", "spread", "sig", "size", "pos"])

    return run


def _cells(t: float, small: int):
    """Pairs from small cells, (set, set, leader) from larger ones, (set, null, gram) of frequent n-grams; rows are sorted by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "star", "size_a", "size_b", "pos_a", "pos_b", "leader"]

        def some(a, b, za, zb, pa_, pb, leader):  # noqa: ANN001, ANN202
            star = leader if b is None or b is a else np.zeros(len(a), np.int64)
            return pa.record_batch([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), *map(pa.array, (star, za, zb, pa_, pb, leader))], names)

        def rare(whole: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in whole:
                often = batch.column(1).to_numpy() > 0
                if often.any():
                    tab = batch.filter(pa.array(often))
                    gram, _, sig, size, pos = (tab.column(k).to_numpy() for k in range(5))
                    held.append(some(sig, None, size, size, pos, pos, gram))
                yield batch.filter(pa.array(~often)) if often.any() else batch

        held: list[pa.RecordBatch] = []
        for tab in by_key(rare(batches), "gram"):
            yield from held
            held.clear()
            gram, sig, size, pos = (tab[c].to_numpy() for c in ("gram", "sig", "size", "pos"))
            order = np.lexsort((sig, gram))
            gram, sig, size, pos = (x[order] for x in (gram, sig, size, pos))
            first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            many = np.diff(np.r_[first, len(gram)])
            leader, k, start = (np.repeat(x, many) for x in (sig[first], many, first))
            big = k > small
            if big.any():
                star, at = np.unique(np.stack([sig[big], leader[big]]), axis=1, return_index=True)
                own, z = star[0], size[big][at]
                yield some(own, own, z, z, z, z, star[1])
            at = np.arange(len(gram))
            for step in range(1, small):
                x = np.flatnonzero(~big & (at - start + step < k))
                if not len(x):
                    break
                y = x + step
                x, y = (v[np.minimum(size[x], size[y]) >= t * np.maximum(size[x], size[y]) - 1e-9] for v in (x, y))
                if len(x):
                    yield some(sig[x], sig[y], size[x], size[y], pos[x], pos[y], leader[x])
        yield from held

    return run


class Trie:
    """Sets as a trie of the items that several of them have, those of most sets first; sets in it are numbered by that order.

    A node is a run of sets, ``lo`` to ``hi``, that agree in their first items; it isn't
    stored, but found from the lengths that neighbours have in common.
    """

    def __init__(self, sets: list[np.ndarray], weights: np.ndarray):
        """sets: arrays of distinct numbers."""
        n = len(sets)
        flat = np.concatenate(sets) if n else np.zeros(0, np.int64)
        row = np.repeat(np.arange(n), [len(x) for x in sets])
        _, item = np.unique(flat, return_inverse=True)
        often = np.bincount(item)
        rank = np.empty(len(often), np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(often))
        shared = often[item] > 1  # no other set has the rest, so they only count for the size
        row, rank = row[shared], rank[item][shared]
        wide = int(rank.max()) + 1 if len(rank) else 1
        row, rank = np.divmod(np.sort(row * wide + rank), wide)
        cuts = np.searchsorted(row, np.arange(n + 1))
        raw, cut = rank.astype(">u4").tobytes(), cuts * 4
        self.order = np.array(sorted(range(n), key=lambda k: raw[cut[k] : cut[k + 1]]), np.int64)
        self.items = [rank[cuts[k] : cuts[k + 1]] for k in self.order]
        self.length = np.diff(cuts)[self.order] if n else np.zeros(0, np.int64)
        self.size = np.array([len(sets[k]) for k in self.order], np.int64)
        self.weight = np.asarray(weights, np.int64)[self.order]
        # which sets, by their new numbers, have an item
        new = np.empty(n, np.int64)
        new[self.order] = np.arange(n)
        item, self.having = np.divmod(np.sort(rank * n + new[row]), max(n, 1))
        self.item_cuts = np.searchsorted(item, np.arange(wide + 1))
        # the same by set: bits for the items that most sets have, a rising array for the others
        self.width = len(self.item_cuts)
        self.flat = np.concatenate([k * self.width + x for k, x in enumerate(self.items)]) if n else np.zeros(0, np.int64)
        words = min(DENSE, wide + 63 >> 6)
        near = rank < 64 * words
        self.bits = np.zeros((n, words), np.uint64)
        np.bitwise_or.at(self.bits, (new[row[near]], rank[near] >> 6), np.uint64(1) << (rank[near] & 63).astype(np.uint64))
        self.upto = np.zeros((n, words + 1), np.int32)
        np.cumsum(np.bitwise_count(self.bits), axis=1, out=self.upto[:, 1:])
        self.ends = np.cumsum(self.length)
        self.common = np.zeros(n, np.int64)
        for k in range(1, n):
            x, y = self.items[k - 1], self.items[k]
            m = min(len(x), len(y))
            other = np.flatnonzero(x[:m] != y[:m])
            self.common[k] = other[0] if len(other) else m

    def _among(self, edge: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many of the edge's items each query has."""
        cut = int(np.searchsorted(edge, 64 * self.bits.shape[1]))
        out = np.zeros(len(q), np.int64)
        if cut:
            x, y = int(edge[0]) >> 6, (int(edge[cut - 1]) >> 6) + 1
            mask = np.zeros(y - x, np.uint64)
            np.bitwise_or.at(mask, (edge[:cut] >> 6) - x, np.uint64(1) << (edge[:cut] & 63).astype(np.uint64))
            out += np.bitwise_count(self.bits[q, x:y] & mask).sum(axis=1, dtype=np.int64)
        if cut < len(edge):
            found = np.concatenate([self.having[self.item_cuts[e] : self.item_cuts[e + 1]] for e in edge[cut:]])
            out += np.bincount(found, minlength=len(self.items))[q]
        return out

    def _behind(self, item: int, q: np.ndarray) -> np.ndarray:
        """How many items each query has behind one."""
        if item >= 64 * self.bits.shape[1]:
            return self.ends[q] - np.searchsorted(self.flat, q * self.width + item, "right")
        low = np.uint64((2 << (item & 63)) - 1)
        return self.length[q] - self.upto[q, item >> 6] - np.bitwise_count(self.bits[q, item >> 6] & low)

    def walk(self, queries: np.ndarray, t: float, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        """(queries, overlaps, lo, hi): each of the queries has a Jaccard of t or more with each of the sets lo to hi.

        ``queries`` are numbers of sets, a set meets itself too.  If not ``whole``, subtrees
        are taken set by set and overlaps are complete.
        """
        n = len(self.items)
        if not n or not len(queries):
            return
        stack = [(0, n, 0, queries, np.zeros(len(queries), np.int64))]
        while stack:
            lo, hi, depth, q, o = stack.pop()
            size, length = self.size[lo:hi], self.length[lo:hi]
            least, most = size.min(), size.max()
            own = self.size[q]
            ok = (most >= t * own - 1e-9) & (own >= t * least - 1e-9)
            to = int(self.length[lo]) if hi - lo == 1 else int(min(self.length[lo], self.common[lo + 1 : hi].min()))
            if to > depth:
                o = o + self._among(self.items[lo][depth:to], q)
            needed = _needed(t, own + np.maximum(least, np.ceil(t * own - 1e-9)))
            ok &= o + (length.max() - to) >= needed
            q, o, own, needed = q[ok], o[ok], own[ok], needed[ok]
            if to and len(q) and hi - lo > 1:
                ok = o + self._behind(int(self.items[lo][to - 1]), q) >= needed
                q, o, own = q[ok], o[ok], own[ok]
            if not len(q):
                continue
            if whole or hi - lo == 1:
                # a complete overlap decides for each size, a partial one only if the largest set below is satisfied
                done = o >= _needed(t, own + most)
                if done.any():
                    yield q[done], o[done], lo, hi
                    q, o = q[~done], o[~done]
                    if not len(q):
                        continue
            if hi - lo == 1:
                continue
            at = lo
            while at < hi and self.length[at] == to:  # sets that end here
                good = o >= _needed(t, self.size[q] + self.size[at])
                if good.any():
                    yield q[good], o[good], at, at + 1
                at += 1
            if at < hi:
                starts = np.r_[at, at + 1 + np.flatnonzero(self.common[at + 1 : hi] == to), hi]
                for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    stack.append((x, y, to, q, o))


def trie_pairs(sets: list[np.ndarray], t: float) -> list[tuple[int, int, int]]:
    """(i, j, overlap) with i < j for all pairs of Jaccard t or more."""
    trie = Trie(sets, np.ones(len(sets)))
    out = []
    for q, o, lo, hi in trie.walk(np.arange(len(sets)), t, whole=False):
        for at in range(lo, hi):
            j = int(trie.order[at])
            out += [(int(i), j, int(k)) for i, k in zip(trie.order[q], o, strict=True) if i < j]
    return out


def _least_of_group(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of n is connected with by edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(sets: list[np.ndarray], weights: np.ndarray, side: np.ndarray, masks: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(links that this task counts for each set, least number of its group); side 0 and 1 meet each other, side 2 itself.

    ``masks``: bits of the earlier blocks each set is in; two sets with a bit in common have been counted there.
    """
    trie, n = Trie(sets, weights), len(sets)
    side, masks = side[trie.order], masks[trie.order]
    links, edges, chain = np.zeros(n, np.int64), [], np.zeros(n + 1, np.int64)
    plain = not masks.any()
    upto = [np.r_[0, np.cumsum(trie.weight * (side == 1 - s if s < 2 else True))] for s in range(3)]
    for q, _, lo, hi in trie.walk(np.arange(n), t, whole=True):
        edges.append((q, np.full(len(q), lo)))
        if hi - lo > 1:
            chain[lo + 1] += 1
            chain[hi] -= 1
        if plain:
            clear = np.ones(len(q), bool)
        else:
            clear = (masks[q] & np.bitwise_or.reduce(masks[lo:hi], axis=0) == 0).all(axis=1)
        for s in range(3):
            own = q[clear & (side[q] == s)]
            links[own] += upto[s][hi] - upto[s][lo]
            if s == 2:
                own = own[(own >= lo) & (own < hi)]
                links[own] -= trie.weight[own]  # itself
        rest = q[~clear]
        for x in range(0, len(rest), 256):
            some = rest[x : x + 256]
            for y in range(lo, hi, 1024):
                z = slice(y, min(hi, y + 1024))
                fresh = (masks[some][:, None, :] & masks[z][None] == 0).all(axis=2)
                fresh &= (side[some][:, None] == 2) | (side[some][:, None] != side[z][None])
                links[some] += fresh @ trie.weight[z]
    together = np.flatnonzero(np.cumsum(chain[:n]) > 0)
    a = np.concatenate([together, *(x for x, _ in edges)]) if edges else together
    b = np.concatenate([together - 1, *(y for _, y in edges)]) if edges else together
    group = _least_of_group(n, a.astype(np.int64), b.astype(np.int64))
    out_links, out_group = np.empty(n, np.int64), np.empty(n, np.int64)
    out_links[trie.order], out_group[trie.order] = links, trie.order[group]
    return out_links, out_group


def _tasks(t: float, pairs: bool):
    """Of each task's sets (name, documents, side, earlier blocks, n-grams) the links and the group, or all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in by_key(batches, "task"):
            task = tab["task"].to_numpy(zero_copy_only=False)
            sig, many, side = (tab[c].to_numpy() for c in ("sig", "many", "side"))
            data, off = B.buffers(tab["grams"])
            before = tab["before"].to_pylist()
            cuts = np.flatnonzero(np.r_[True, task[1:] != task[:-1], True])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo < 2:
                    continue
                grams = [np.frombuffer(data[off[k] : off[k + 1]].tobytes(), np.uint64) for k in range(lo, hi)]
                bit = {x: i for i, x in enumerate(sorted({x for k in range(lo, hi) for x in before[k]}))}
                masks = np.zeros((hi - lo, 1 + len(bit) // 64), np.uint64)
                for k in range(lo, hi):
                    for x in before[k]:
                        masks[k - lo, bit[x] // 64] |= np.uint64(1 << bit[x] % 64)
                if pairs:
                    found = [(i, j, o) for i, j, o in trie_pairs(grams, t) if (side[lo + i] == 2 or side[lo + i] != side[lo + j]) and not (masks[i] & masks[j]).any()]
                    if found:
                        i, j, o = (np.array(x, np.int64) for x in zip(*found, strict=True))
                        size = np.array([len(x) for x in grams])
                        a, b = sig[lo:hi][i], sig[lo:hi][j]
                        yield pa.record_batch([pa.array(x) for x in (np.minimum(a, b), np.maximum(a, b), o / (size[i] + size[j] - o))], ["a", "b", "jaccard"])
                    continue
                links, group = _links(grams, many[lo:hi], side[lo:hi], masks, t)
                alone = np.bincount(group, minlength=hi - lo)[group] < 2
                if not alone.all():
                    yield pa.record_batch([pa.array(x[~alone]) for x in (sig[lo:hi], sig[lo:hi][group], links)], ["sig", "root", "links"])

    return run


def _third_pass(n: int, clashing: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, bounds, g in _sets(batch, n):
                raw, at = g.tobytes(), pa.array(rows)
                yield pa.record_batch([*(batch.column(k).take(at) for k in range(3)), pa.array(_names(signatures(bounds, g), clashing)), pa.array([raw[8 * x : 8 * y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], [*KEY, "sig", "grams"])

    return run


def _once(docs: DataFrame, spare: DataFrame) -> DataFrame:
    """KEY and text of each row that isn't in ``spare`` (KEY, stays), rows that stay but are repeated once."""
    clear, rest = split(docs, spare)
    text = F.col("row").getField("text").alias("text")
    rest = rest.select(*KEY, text).join(spare.hint("merge"), list(KEY), "left").where("stays is null or stays")
    once = rest.where("stays").groupBy(*KEY).agg(F.first("text").alias("text"))
    return clear.select(*KEY, text).where("doc_id is not null and text is not null").unionByName(rest.where("stays is null").select(*KEY, "text")).unionByName(once)


def _joined(docs: DataFrame, threshold: float, n: int, small_cell: int, pairs: bool) -> tuple[DataFrame, DataFrame]:
    """(members, result of the tasks): KEY and sig of each document with a set; sig, root and links, or a, b and jaccard; written tables."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    docs = docs.select(whole_id().alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = docs.where("doc_id is not null and text is not null").select(*keys(), "text")
    first = written(source.mapInArrow(frugal(_first_pass(n)), "doc_id long, key_a long, key_b long, sig long, sig2 long, size long, block long, counts binary"), "ngram-sets")
    blocks = first.where("block is not null").select("block", "counts").repartition("block").sortWithinPartitions("block").mapInArrow(frugal(_sum_blocks), "block long, counts binary").collect()
    sketch = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in blocks:  # 64 rows at most
        sketch[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.uint8)
    sketch = sc.broadcast(sketch.tobytes())

    rows = first.where("sig is not null").groupBy(*KEY, "sig", "sig2", "size").agg(F.count("*").alias("rows"))
    # sets that differ and have the same 64-bit sum: at 10**11 sets some hundred are expected
    clashing = [r.sig for r in rows.groupBy("sig").agg(F.min("sig2").alias("x"), F.max("sig2").alias("y")).where("x <> y").select("sig").collect()]
    if clashing:
        rows = rows.withColumn("sig", F.when(F.col("sig").isin(clashing), F.col("sig").bitwiseXOR(F.col("sig2"))).otherwise(F.col("sig")))
    clashing = np.array(clashing, np.int64)
    members = written(rows.select(*KEY, "sig", "size", "rows"), "ngram-members")
    discard(first)
    heads = written(members.groupBy("sig").agg(F.min(F.struct(*KEY)).alias("head"), F.count("*").alias("many"), F.first("size").alias("size")), "ngram-heads")
    several = members.join(heads.where("many > 1").select("sig", "head"), "sig")
    spare = several.where(F.struct(*KEY) != F.col("head")).select(*KEY, F.lit(False).alias("stays"))
    again = members.where("rows > 1").join(heads.select("sig", "head"), "sig").where(F.struct(*KEY) == F.col("head")).select(*KEY, F.lit(True).alias("stays"))
    spare = written(spare.unionByName(again), "ngram-spare")

    single = _once(docs, spare)
    prefix = single.select("text").mapInArrow(frugal(_second_pass(n, threshold, sketch, clashing)), "gram long, spread int, sig long, size int, pos int")
    live = prefix.withColumn("cell", F.count("*").over(Window.partitionBy("gram", "spread"))).where("cell > 1 or spread > 0").select("gram", "spread", "sig", "size", "pos")
    cells = live.mapInArrow(frugal(_cells(threshold, small_cell)), "a long, b long, star long, size_a int, size_b int, pos_a int, pos_b int, leader long")
    cells = written(cells.groupBy("a", "b", "star").agg(F.count("*").alias("common"), *(F.max(c).alias(c) for c in ("size_a", "size_b", "pos_a", "pos_b")), F.min("leader").alias("leader")), "ngram-cells")
    often = cells.where("b is null").groupBy("leader").agg(F.min("a").alias("least"), F.count("*").alias("cell")).where("cell > 1").select("leader", "least")
    stars = cells.where("b = a").select(F.col("a").alias("sig"), F.col("leader").alias("block")).unionByName(cells.where("b is null").join(often, "leader").select(F.col("a").alias("sig"), F.col("least").alias("block")))
    # All of the overlap past the last common n-gram of both prefixes lies behind its places, and past the earlier of the prefix ends.
    behind = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) - 1
    rest = F.greatest(*(F.ceil(F.col(s) * F.lit(threshold) - 1e-9) - 1 for s in ("size_a", "size_b")))
    needed = F.greatest(F.lit(1), F.ceil((F.col("size_a") + F.col("size_b")) * F.lit(threshold / (1 + threshold)) - 1e-9))
    possible = cells.where(F.col("b") != F.col("a")).where(F.col("common") + F.least(behind, rest) >= needed)
    places = possible.select(F.explode(F.array("a", "b")).alias("sig"), F.col("leader").alias("block")).unionByName(stars).distinct()
    places = written(places.join(heads.select("sig", "size"), "sig").select("sig", "block", "size"), "ngram-places")
    discard(cells)

    # where a set is: its tasks, and the blocks before each, which count a link first
    spread = places.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_GRAMS)).cast("int").alias("shards"))
    own = places.groupBy("sig").agg(F.sort_array(F.collect_set("block")).alias("own"))  # not more than the set's prefix has n-grams
    placed = places.join(spread, "block").join(own, "sig").withColumn("shard", F.pmod(F.xxhash64("sig"), "shards").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    side = F.when(F.col("other") == F.col("shard"), 2).when(F.col("shard") < F.col("other"), 0).otherwise(1).alias("side")
    task = F.concat_ws("/", "block", F.least("shard", "other"), F.greatest("shard", "other")).alias("task")
    placed = placed.select("sig", task, side, F.filter("own", lambda x: x < F.col("block")).alias("before"))
    wanted = written(heads.join(own.select("sig"), "sig", "left_semi").select(F.col("head.doc_id").alias("doc_id"), F.col("head.key_a").alias("key_a"), F.col("head.key_b").alias("key_b"), "sig", "many"), "ngram-live")
    among = may_be_among(wanted.select(F.xxhash64(*KEY).alias("key")))
    sets = single.where(among(F.xxhash64(*KEY))).mapInArrow(frugal(_third_pass(n, clashing)), "doc_id long, key_a long, key_b long, sig long, grams binary").join(wanted.hint("merge"), [*KEY, "sig"])
    met = placed.join(sets.select("sig", "many", "grams"), "sig").repartition("task").sortWithinPartitions("task", "sig")
    out = written(met.select("task", "sig", "many", "side", "before", "grams").mapInArrow(frugal(_tasks(threshold, pairs)), "a long, b long, jaccard double" if pairs else "sig long, root long, links long"), "ngram-links")
    discard(places, wanted, spare)
    return members, heads, out


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, small_cell: int = SMALL_CELL) -> DataFrame:
    """Every pair of distinct n-gram sets with a Jaccard similarity of at least ``threshold``.

    Returns doc_a <= doc_b, the least doc_id of the documents that have either set,
    and jaccard.  Documents of equal sets are represented by the least of them and
    give no pairs among themselves.  Nulls, words, short texts and repeated rows
    are treated as in ``near_classes``.
    """
    members, heads, pairs = _joined(docs, threshold, n, small_cell, True)
    ids = heads.select("sig", F.col("head.doc_id").alias("doc_id"))
    out = pairs.join(ids.select(F.col("sig").alias("a"), F.col("doc_id").alias("x")), "a").join(ids.select(F.col("sig").alias("b"), F.col("doc_id").alias("y")), "b")
    out = written(out.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard"), "ngram-pairs")
    discard(members, heads, pairs)
    return out


def _labelled(edges: DataFrame) -> DataFrame:
    """sig and label, the least name of its connected component, by edges (sig, root); a written table.

    Minimum labels with pointer jumping: the number of rounds grows with the logarithm of a group's width.
    """
    edges = written(edges.select("sig", "root").unionByName(edges.select(F.col("root").alias("sig"), F.col("sig").alias("root"))).distinct(), "near-edges")
    label = written(edges.groupBy("sig").agg(F.least("sig", F.min("root")).alias("label")), "near-label")
    while True:
        around = edges.join(label.select(F.col("sig").alias("root"), "label"), "root").groupBy("sig").agg(F.min("label").alias("near"))
        step = written(label.join(around, "sig").select("sig", F.col("label").alias("old"), F.least("label", "near").alias("label")), "near-step")
        hop = step.select(F.col("sig").alias("label"), F.col("label").alias("next"))
        new = written(step.join(hop, "label", "left").select("sig", "old", F.coalesce(F.least("next", "label"), "label").alias("label")), "near-label")
        discard(label, step)
        label = new
        if new.where("label <> old").isEmpty():
            discard(edges)
            return label


def _classes(docs: DataFrame, threshold: float, n: int, small_cell: int) -> DataFrame:
    """KEY, class (the least KEY of its group) and links of each document that has a link; a written table."""
    members, heads, links = _joined(docs, threshold, n, small_cell, False)
    label = _labelled(links.where("sig <> root"))
    counted = links.groupBy("sig").agg(F.sum("links").alias("links"))
    info = heads.join(label.select("sig", "label"), "sig", "left").join(counted, "sig", "left").where("many > 1 or label is not null")
    info = info.select("sig", "head", F.coalesce("label", "sig").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"))
    info = info.join(info.groupBy("label").agg(F.min("head").alias("class")), "label").select("sig", "class", "links")
    out = written(members.select(*KEY, "sig").join(info, "sig").select(*KEY, "class", "links"), "near-classes")
    discard(members, heads, links, label)
    return out


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, small_cell: int = SMALL_CELL) -> DataFrame:
    """doc_id, class_id and links of every document that has a near duplicate; the others have no row.

    ``links`` is the number of other documents whose word n-gram sets have a Jaccard
    similarity of at least ``threshold`` with the document's own, copies included.
    Classes are the connected components of these links; ``class_id`` is a class's
    least doc_id.  Rows with a null text, or a doc_id that is null or no whole
    number, and texts without a word, have no set and no links.  A text of fewer
    than n words has one n-gram, all its words.  Repeated rows of one doc_id and text
    count once; rows that share a doc_id but not their text are documents of
    their own, so ids that are given twice can appear twice.  Columns other than doc_id and text
    aren't read; an empty table gives no row.
    """
    return _classes(docs, threshold, n, small_cell).select("doc_id", F.col("class.doc_id").alias("class_id"), "links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """One document, that of the least doc_id, of each class of ``near_classes``, with all columns whatever their names.

    Rows go by doc_id and text together, so a row with another text under a doc_id
    that goes stays.  Documents without links, with nulls or without words, stay;
    so do repeated rows of a document that stays.
    """
    classes = _classes(docs, threshold, n, SMALL_CELL)
    gone = written(classes.where(F.struct(*KEY) != F.col("class")).select(*KEY), "near-gone")
    discard(classes)
    return without(docs, gone)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = f"regexp_extract_all(translate(text, '{_UP}', '{_UP.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = {
    "op6_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < {N} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {N} + 2), lambda i: array_to_string(ws[i:i + {N} - 1], ' ')) END) AS gram
  FROM w WHERE len(ws) > 0),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE CAST(c AS DOUBLE) / (sa.n + sb.n - c) >= {THRESHOLD}),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS doc_id, least(a, min(b)) AS class_id, (SELECT count(*) FROM e WHERE e.a = r.a) AS links FROM r GROUP BY a"""
}
QUERIES = {"op6_ngram_jaccard_join": op6_ngram_jaccard_join}
