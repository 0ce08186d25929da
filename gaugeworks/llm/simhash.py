"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is cut into budget + 1 segments on a ring. If two fingerprints differ in at most `budget` bits, some
segment starts a chain in which the first l segments differ in at most l - 1 bits, for every l. The first two segments of
a chain are the join key: equal in the first, within one bit in the second (all such variants are written on one side).
Runs of equal keys stream past in sorted order; candidates that go on along the chain get the full Hamming check.
Runs with many candidates are searched breadth-first, so a group of n near copies gives n - 1 links, not all its pairs.

Equal fingerprints collapse before the join, and classes are the connected components of the links.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; a text with fewer words
than a shingle is one shingle; repeated rows and null doc_ids are rows like any other (nulls never name a class unless
all its doc_ids are null); extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import drop_scratch, stored, stored_at
from gaugeworks.llm.components import components
from gaugeworks.llm.words import word_pieces, xxh64

#: Shingles whose bits are counted at once, and pairs that are compared at once.
BIT_ROWS, PAIRS = 1 << 16, 1 << 20


def _majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A fingerprint per text from its shingles' hashes: bits that over half of the hashes have."""
    counts = np.zeros((len(n), 64), np.int64)
    of = np.repeat(np.arange(len(n)), n)
    for at in range(0, len(h), BIT_ROWS):
        part, text = h[at : at + BIT_ROWS], of[at : at + BIT_ROWS]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        counts[text[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_batch(column: pa.Array, words: int) -> np.ndarray:
    out = np.zeros(len(column), np.uint64)
    for at, to, w in word_pieces(column, lower=True):
        start, end, n = w.shingles(words)
        if len(start):
            out[at:to] = _majority(xxh64(w.buf, start, end, 42), n)
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp: the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprint_batch(b.column(1), words).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def _segments(budget: int) -> list[tuple[int, int]]:
    """(shift, width) of budget + 1 segments over 64 bits."""
    cuts = [64 * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def keys_batch(fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, fp) rows: bit 0 of a key's last column tells probes (exact key) from the index (all variants)."""
    segments = _segments(budget)
    keys, of = [], []
    for i, (shift, width) in enumerate(segments):
        shift2, width2 = segments[(i + 1) % len(segments)]
        one = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        two = (fp >> np.uint64(shift2)) & np.uint64((1 << width2) - 1)
        base = (np.uint64(i) << np.uint64(57)) | (one << np.uint64(width2))
        keys.append((base | two) << np.uint64(1) | np.uint64(1))
        of.append(fp)
        for variant in (0, *(1 << b for b in range(width2))):
            keys.append((base | (two ^ np.uint64(variant))) << np.uint64(1))
            of.append(fp)
    return np.concatenate(keys), np.concatenate(of)


def chain_masks(budget: int) -> np.ndarray:
    """masks[i, l - 1]: the bits of the l segments from segment i on, around the ring."""
    own = np.array([((1 << width) - 1) << shift for shift, width in _segments(budget)], np.uint64)
    return np.array([[np.bitwise_or.reduce(np.roll(own, -i)[: n + 1]) for n in range(len(own))] for i in range(len(own))])


def on_chain(diff: np.ndarray, start: np.ndarray, budget: int) -> np.ndarray:
    """Which of the differences of candidates go on along the chain from segment `start`: their first l segments differ in
    at most l - 1 bits, for l from 3 (a key has the first two) up to all but the last, whose test is the Hamming check."""
    masks, left = chain_masks(budget), np.arange(len(diff))
    for n in range(2, budget):
        left = left[np.bitwise_count(diff[left] & masks[start[left], n]) <= n]
    return left


def _search(fps: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Tree edges of the components of fps (distinct) under `budget` bits, by breadth-first search in blocks. All of a run's
    pairs within budget are links, whether this run's chain or another's leads to them."""
    rest, a, b = fps, [], []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            next_front, at = [], 0
            while at < len(front) and len(rest):
                block = front[at : at + max(1, PAIRS // len(rest))]
                near = np.bitwise_count(block[:, None] ^ rest[None, :]) <= budget
                hit = near.any(axis=0)
                a.append(rest[hit])
                b.append(block[near[:, hit].argmax(axis=0)])
                next_front.append(rest[hit])
                rest, at = rest[~hit], at + len(block)
            front = np.concatenate(next_front)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links_of_runs(key: np.ndarray, fp: np.ndarray, budget: int, wide: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Links from whole runs of equal keys (key without its last bit). A run with more than `wide` candidate pairs is searched."""
    run = key >> np.uint64(1)
    begins = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    ends = np.append(begins[1:], len(run))
    probe = (key & np.uint64(1)).astype(np.int64)
    probes = np.add.reduceat(probe, begins)
    pairs = probes * (ends - begins - probes)
    a, b = [], []
    for i in np.flatnonzero(pairs > wide):
        x, y = _search(np.unique(fp[begins[i] : ends[i]]), budget)
        a.append(x)
        b.append(y)
    some = (pairs <= wide) & (probes > 0) & (ends - begins > 2)  # a probe meets its own variant 0
    rows = np.flatnonzero(probe)
    of = np.searchsorted(begins, rows, side="right") - 1
    rows, of = rows[some[of]], of[some[of]]
    size = (ends - begins)[of]
    cuts = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), PAIRS)).tolist() + [len(rows)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        r, n = rows[lo:hi], size[lo:hi]
        if not len(r):
            continue
        left = np.repeat(fp[r], n)
        right = fp[np.repeat(begins[of[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        apart = np.flatnonzero(left < right)  # the other way round they meet again
        start = (np.repeat(run[r], n)[apart] >> np.uint64(57)).astype(np.int64)
        near = apart[on_chain(left[apart] ^ right[apart], start, budget)]
        near = near[np.bitwise_count(left[near] ^ right[near]) <= budget]
        a.append(left[near])
        b.append(right[near])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(fps: DataFrame, budget: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose components are those of all pairs within budget."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 1 << 14):
                key, of = keys_batch(fp[at : at + (1 << 14)], budget)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array((key >> np.uint64(1)).view(np.int64)), pa.array(of.view(np.int64))], names=["key", "run", "fp"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def out(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(key):
                x, y = links_of_runs(key, fp, budget)
                yield pa.record_batch([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held_key = np.concatenate([held_key, batch.column(0).to_numpy().view(np.uint64)])
            held_fp = np.concatenate([held_fp, batch.column(1).to_numpy().view(np.uint64)])
            if len(held_key) < 1 << 17:
                continue
            run = held_key >> np.uint64(1)
            cut = int(np.searchsorted(run, run[-1])) if len(run) else 0  # the last run may go on
            yield from out(held_key[:cut], held_fp[:cut])
            held_key, held_fp = held_key[cut:], held_fp[cut:]
        yield from out(held_key, held_fp)

    rows = fps.select("fp").mapInArrow(expand, "key long, run long, fp long")
    return rows.repartition("run").sortWithinPartitions("run").select("key", "fp").mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that is reachable)."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    unique = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(unique, budget))
    named = unique.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "classes")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(ids, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near-duplicate texts. SimHash links, confirmed by shingles, join most of a group. The rest, which fingerprints can miss, share
# one of their rarest shingles.

#: A run with more matches per member than this is compared with hubs first.
MATCHES = 16
#: Hubs of the first pass; each pass has so many times more.
HUBS, MORE = 16, 16
#: Documents whose shingles and words are counted, to know common ones, and how many of each are told apart.
COUNTED, COMMON = 20_000, 1 << 16
#: Buckets of a sketch, and pairs a text whose sketches are joined at once.
BUCKETS, AT_ONCE = 256, 8
#: Places of a run that are compared at once, and pairs that are held: a worker keeps several arrays of that length.
PLACES = 1 << 16


def text_digest(text: Column) -> Column:
    """SHA-256 of the text (null: empty), which stands for it: 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def shingle_sets(column: pa.Array, words: int) -> pa.Array:
    """Each text's distinct shingle hashes, sorted."""
    return weighed_sets(column, words, (np.zeros(0, np.int64), np.zeros(0, np.int64)))[0]


def weighed_sets(column: pa.Array, words: int, common: tuple[np.ndarray, np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """The same, and each shingle's weight: the sum over its words, in `common` by sorted hash; other words weigh 0."""
    parts, weights, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for at, to, w in word_pieces(column, lower=True):
        head, tail, n = w.spans(words)
        h, of = xxh64(w.buf, w.start[head], w.end[tail], 42).view(np.int64), np.repeat(np.arange(to - at), n)
        weight = np.zeros(len(h), np.int64)
        if len(common[0]):
            own = w.hashes().view(np.int64)
            place = np.minimum(np.searchsorted(common[0], own), len(common[0]) - 1)
            up_to = np.concatenate([[0], np.cumsum(np.where(common[0][place] == own, common[1][place], 0))])
            weight = up_to[tail + 1] - up_to[head]
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        parts.append(h[new])
        weights.append(weight[order][new])
        sizes.append(np.bincount(of[new], minlength=to - at))
    return pa.LargeListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int64()), pa.array(np.concatenate(parts))), np.concatenate(weights)


def common_parts(docs: DataFrame, words: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Of about COUNTED documents, the shingles that most of them hold, by rising number of documents, and their most frequent
    words: sorted hashes and weights, eight for each power of two in their number. Only an order follows from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                some = b.column(0).slice(at, 64)
                own = [np.zeros(0, np.int64), *(w.hashes().view(np.int64) for _, _, w in word_pieces(some, lower=True))]
                for kind, h in enumerate((shingle_sets(some, words).values.to_numpy(), np.concatenate(own))):
                    h, n = np.unique(h, return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(h), kind, np.int32)), pa.array(h), pa.array(n)], names=["kind", "hash", "n"])

    every = max(1, docs.count() // COUNTED)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    counts = some.mapInArrow(run, "kind int, hash long, n long").groupBy("kind", "hash").agg(F.sum("n").alias("n")).where("n > 2")
    counts, path = stored_at(counts, "common")
    shingles, own = (counts.where(F.col("kind") == k).orderBy(F.desc("n"), "hash").limit(COMMON).collect() for k in (0, 1))
    drop_scratch(docs.sparkSession, path)
    own = sorted((r.hash, round(8 * np.log2(r.n))) for r in own)
    return np.array([r.hash for r in reversed(shingles)], np.int64), (np.array([h for h, _ in own], np.int64), np.array([n for _, n in own], np.int64))


def prefixes(sets: pa.Array, weight: np.ndarray, similarity: float, common: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each set's size, and the first of its shingles in an order that all texts share: those of rare words (a small weight)
    first, common ones last. Sets with a Jaccard similarity of at least `similarity` share one of these. A text without
    shingles has a 0."""
    ends = sets.offsets.to_numpy()
    h, size = sets.values.to_numpy(), np.diff(ends)
    by_hash = np.argsort(common)
    rank = weight.copy()
    if len(common):
        at = np.minimum(np.searchsorted(common, h, sorter=by_hash), len(common) - 1)
        known = common[by_hash[at]] == h
        rank[known] = by_hash[at[known]] + (1 << 32)
    h = h[np.lexsort((h, rank, np.repeat(np.arange(len(size)), size)))]
    n = size - np.ceil(similarity * size - 1e-6).astype(np.int64) + 1
    begins = np.cumsum(n) - n
    own = np.repeat(ends[:-1] - begins, n) + np.arange(n.sum())
    first = np.append(h, 0)[np.where(np.repeat(size == 0, n), len(h), own)]
    return size, pa.ListArray.from_arrays(pa.array(np.append(begins, n.sum()), pa.int32()), pa.array(first))


def sketches(sets: pa.Array) -> pa.Array:
    """Each set's number of shingles in every bucket of hashes, one byte each (255: as many or more)."""
    size = np.diff(sets.offsets.to_numpy())
    bucket = np.repeat(np.arange(len(size)) * BUCKETS, size) + (sets.values.to_numpy().view(np.uint64) >> np.uint64(56)).astype(np.int64)
    counts = np.minimum(np.bincount(bucket, minlength=BUCKETS * len(size)), 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.arange(len(size) + 1, dtype=np.int32) * BUCKETS), pa.py_buffer(counts)])


def _sketched(column: pa.Array) -> np.ndarray:
    n, at = len(column), int(np.frombuffer(column.buffers()[1], np.int32)[column.offset]) if len(column) else 0
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at : at + n * BUCKETS].reshape(n, BUCKETS).astype(np.int16)


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> tuple[DataFrame, list[str]]:
    """The pairs (a, b) whose sketches leave it open whether they are similar, and where they are stored. Sets differ in at least
    as many shingles as their buckets do, so no similar pair goes. Pairs are joined to sketches in parts, each of AT_ONCE
    pairs a node at most, so that disk doesn't grow with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                size = part.column(2).to_numpy().astype(np.int64) + part.column(4).to_numpy()
                apart = np.abs(_sketched(part.column(3)) - _sketched(part.column(5))).sum(axis=1)
                keep = apart <= size - 2 * np.ceil(similarity / (1 + similarity) * size - 1e-6)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    ends = [nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
    parts = max(1, -(-pairs.count() // (AT_ONCE * max(1, nodes.count()))))
    found = []
    for k in range(parts):
        own = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == k)
        both = own.join(ends[0], "a").join(ends[1], "b").select("a", "b", "size_a", "sketch_a", "size_b", "sketch_b")
        found.append(stored_at(both.mapInArrow(run, "a long, b long"), "possible"))
    return functools.reduce(DataFrame.union, (x for x, _ in found)), [path for _, path in found]


def _may(size_a: np.ndarray, place_a: np.ndarray, size_b: np.ndarray, place_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets can still be similar if the shingles at these places are the first that they share."""
    need = np.ceil(similarity / (1 + similarity) * (size_a + size_b) - 1e-6)
    return np.minimum(size_a - place_a, size_b - place_b) >= need


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _matches(node: np.ndarray, group: np.ndarray, size: np.ndarray, place: np.ndarray, similarity: float, hubs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of one run that may be similar and are of different groups. In a dense run, only the pairs with `hubs`
    of its nodes, those with the fewest rarer shingles, and each node with itself."""

    def near(rows: np.ndarray) -> np.ndarray:
        return (group[rows, None] != group[None, :]) & _may(size[rows, None], place[rows, None], size[None, :], place[None, :], similarity)

    block, held, found = max(1, PLACES // len(node)), [], 0
    for at in range(0, len(node), block):
        own = np.arange(at, min(at + block, len(node)))
        i, j = np.nonzero(near(own) & (node[own, None] < node[None, :]))
        found += len(i)
        if found > MATCHES * len(node) and hubs < len(node):
            chosen = np.lexsort((node, place))[:hubs]
            for low in range(0, hubs, block):
                part = chosen[low : low + block]
                i, j = np.nonzero(near(part))
                yield node[part[i]], node[j]
            yield node, node
            return
        if hubs < len(node):
            held.append((node[own[i]], node[j]))
        else:
            yield node[own[i]], node[j]
    yield from held


def _small_runs(begins: np.ndarray, n: np.ndarray, node: np.ndarray, group: np.ndarray, size: np.ndarray, place: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for many runs of few rows at once: run k has the n[k] rows from begins[k]."""
    rows = np.repeat(begins - np.cumsum(n) + n, n) + np.arange(n.sum())
    of, count = np.repeat(begins, n), np.repeat(n, n)
    cuts = np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()), PLACES)).tolist() + [len(rows)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        k = count[lo:hi]
        x = np.repeat(rows[lo:hi], k)
        y = np.repeat(of[lo:hi] - np.cumsum(k) + k, k) + np.arange(k.sum())
        keep = (node[x] < node[y]) & (group[x] != group[y])
        x, y = x[keep], y[keep]
        keep = _may(size[x], place[x], size[y], place[y], similarity)
        yield node[x[keep]], node[y[keep]]


def candidate_pairs(nodes: DataFrame, similarity: float, hubs: int) -> DataFrame:
    """(a, b), a < b: nodes (columns node, group, size, prefix) of different groups that share a shingle of their prefixes. A row
    with a = b marks a node of a dense run, whose pairs aren't all there: those with its hubs are."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(3).offsets.to_numpy()
            n = np.diff(ends)
            of = np.repeat(np.arange(len(n)), n)
            first = batch.column(3).values.to_numpy()[ends[0] : ends[-1]]
            place = (np.arange(len(of)) - np.repeat(ends[:-1] - ends[0], n)).astype(np.int32)
            node, group, size = (batch.column(i).to_numpy() for i in range(3))
            for at in range(0, len(of), 1 << 16):
                part = of[at : at + (1 << 16)]
                yield pa.record_batch([pa.array(first[at : at + (1 << 16)]), pa.array(node[part]), pa.array(group[part]), pa.array(size[part]), pa.array(place[at : at + (1 << 16)])], names=["run", "node", "group", "size", "place"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32)]

        def found(run: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            begins = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            n = np.diff(np.append(begins, len(run)))
            few = (n > 1) & (n <= 2 * MATCHES + 1)  # can't be dense
            yield from _small_runs(begins[few], n[few], *columns, similarity)
            for i in np.flatnonzero(n > max(1, 2 * MATCHES + 1)):
                yield from _matches(*(x[begins[i] : begins[i] + n[i]] for x in columns), similarity, hubs)

        def out(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            got, total = [], 0
            for pair in found(*rows) if len(rows[0]) else ():
                got.append(pair)
                total += len(pair[0])
                if total > PLACES:
                    yield _pairs(*map(np.concatenate, zip(*got, strict=True)))
                    got, total = [], 0
            if total:
                yield _pairs(*map(np.concatenate, zip(*got, strict=True)))

        waiting, count = [], 0
        for batch in batches:
            waiting.append([c.to_numpy() for c in batch.columns])
            count += batch.num_rows
            if count < 1 << 17:
                continue
            rows = [np.concatenate(x) for x in zip(held, *waiting, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last run may go on
            yield from out([x[:cut] for x in rows])
            held, waiting, count = [x[cut:] for x in rows], [], 0
        yield from out([np.concatenate(x) for x in zip(held, *waiting, strict=True)])

    rows = nodes.select("node", "group", "size", "prefix").mapInArrow(expand, "run long, node long, group long, size int, place int")
    return rows.repartition("run").sortWithinPartitions("run").mapInArrow(join, "a long, b long").distinct()


def simhash_pairs(nodes: DataFrame, budget: int) -> DataFrame:
    """(a, b): nodes (columns node, fp) whose fingerprints the pigeonring filter links, n - 1 pairs for a group of n."""
    least = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = nodes.join(least, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(least, budget).distinct()
    ends = [least.select(F.col("fp").alias(of), F.col("first").alias(name)) for of, name in (("a", "x"), ("b", "y"))]
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return same.union(near)


def similar(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least `similarity`; blank texts are alike."""

    def own_sets(node: pa.Array, text: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Which set is whose: each node's text is worked on once."""
        _, first, which = np.unique(node.to_numpy(), return_index=True, return_inverse=True)
        return which, shingle_sets(text.take(pa.array(first)), words)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                (i, x), (j, y) = (own_sets(part.column(k), part.column(k + 2)) for k in (0, 1))
                keep = np.zeros(part.num_rows, bool)
                for k in range(part.num_rows):
                    one, two = x[i[k]].values.to_numpy(), y[j[k]].values.to_numpy()
                    shared = len(np.intersect1d(one, two, assume_unique=True))
                    whole = len(one) + len(two) - shared
                    keep[k] = whole == 0 or shared >= similarity * whole - 1e-9
                yield part.select(["a", "b"]).filter(pa.array(keep))

    pairs, pairs_at = possible(pairs, nodes, similarity)
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # one document of each text: thousands of copies aren't sent. Texts are sent, since hashes don't compress
    chosen, chosen_at = stored_at(nodes.join(asked, "node", "left_semi").select("node", F.col("digest").alias("d"), "least"), "asked")
    own = texts.join(chosen, (texts["digest"] == chosen["d"]) & texts["doc_id"].eqNullSafe(chosen["least"]))
    own, own_at = stored_at(own.groupBy("node").agg(F.max("text").alias("text")), "asked-texts")
    left = pairs.join(own.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(own.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    out = stored(both.mapInArrow(compare, "a long, b long"), "links")
    drop_scratch(texts.sparkSession, chosen_at, own_at, *pairs_at)
    return out


def near_duplicate_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8, budget: int = 3) -> DataFrame:
    """doc_id, digest, root, component_id: classes of texts linked by a shingle similarity (Jaccard) of at least `similarity`.

    The pigeonring filter's SimHash links come first and join most of a group of near copies, each confirmed by all the
    `words`-word shingles of its two texts. Similar texts whose fingerprints differ in more than `budget` bits share one
    of their first shingles in an order that puts common ones last: as many that two such texts can't miss each other.
    Those pairs, if no link joins them yet, are compared in the same way. A run of texts that leaves too many pairs is
    first compared with a few hubs, then, if links leave pairs apart still, with 16 times as many, and so on until all
    are compared: no link between classes is lost, and no task lists the pairs of a linked group. Texts are read only for
    the pairs that may be similar by their sketches.

    Null, empty and blank texts are similar to each other and to no other text; a text with fewer words than a shingle is
    one shingle; null doc_ids and repeated rows are rows like any other; extra columns are left out.
    """
    d = docs.select("doc_id", text_digest(F.col("text")).alias("digest"), "text")
    common, common_words = common_parts(d, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets, weight = weighed_sets(part.column(2), words, common_words)
                size, first = prefixes(sets, weight, similarity, common)
                fp = fingerprint_batch(part.column(2), words).view(np.int64)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(size.astype(np.int32)), first, pa.array(fp), sketches(sets)], names=["doc_id", "digest", "size", "prefix", "fp", "sketch"])

    prints = d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, digest binary, size int, prefix array<long>, fp long, sketch binary")
    distinct = prints.groupBy("digest").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least"))
    nodes = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "texts")  # fixed by the write
    pairs, pairs_at = stored_at(simhash_pairs(nodes, budget), "fingerprint-pairs")
    found = components(similar(pairs, d, nodes, words, similarity))
    drop_scratch(docs.sparkSession, pairs_at)
    hubs, own = HUBS, nodes
    while True:
        rows = own.join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node", F.coalesce("root", "node").alias("group"), "size", "prefix")
        pairs, pairs_at = stored_at(candidate_pairs(rows, similarity, hubs), "candidates")
        more = similar(pairs.where("a < b"), d, nodes, words, similarity)
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
        dense = stored(pairs.where("a = b").select(F.col("a").alias("node")), "dense")
        drop_scratch(docs.sparkSession, pairs_at)
        if not dense.limit(1).count():
            break
        own, hubs = nodes.join(dense, "node", "left_semi"), hubs * MORE
    named = nodes.join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("digest", "least", F.coalesce("root", "node").alias("root"))
    named = stored(named, "text-classes")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(ids, "root").select("digest", "root", "component_id")
    return d.select("doc_id", "digest").join(classes, "digest").select("doc_id", "digest", "root", "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with the smallest doc_id of each class of near-duplicate texts, with all of their columns.

    Null doc_ids count as larger than all others. Of rows with that doc_id and the same text one stays. Blank texts are one
    class; an empty table stays empty; extra columns are kept, whatever their names.
    """
    classes = near_duplicate_texts(docs, words, similarity)
    # a class's smallest doc_id, and one of the texts under it
    chosen = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("one")).select(F.col("one.doc_id").alias("id"), F.col("one.digest").alias("d"))
    rows = docs.select("doc_id", text_digest(F.col("text")).alias("digest"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = rows.join(chosen, (rows["digest"] == chosen["d"]) & rows["doc_id"].eqNullSafe(chosen["id"]), "left_semi")
    if classes.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count():  # rows that share doc_id and text
        kept = kept.dropDuplicates(["doc_id", "digest"])
    return kept.select("row.*")
