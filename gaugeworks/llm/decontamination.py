"""Benchmark decontamination by spaced-seed hashing.

Texts become tokens: lower-cased runs of bytes other than ASCII white space and ASCII punctuation. Fixed masks over 8
successive tokens leave out 3 of them, so a seed still hits where those were changed. Seeds of documents meet the sorted
seeds of benchmark items; around each hit the two texts are laid side by side, and a leak is a stretch of
min(item, WINDOW) aligned tokens of which at least `similarity` are equal. The masks hit whatever tokens a stretch of 12 or 13
may differ in. Items of 5 to 11 tokens have masks of their own length: cut into two parts more than tokens may
differ, two parts at least are whole, and there is a mask for every two. Items of fewer than 5 tokens, which any
text may hold by chance, are a leak only where they are a document's whole text.

The benchmark is taken in blocks of at most `block_tokens` tokens, each sent to the executors with its own scan, so what
is broadcast stays bounded however long the benchmark is; nothing is shuffled.

Defined cases: null and blank texts and items have no tokens and no leaks; repeated rows are each judged (the report has one row per doc_id and item);
extra columns are left out of the report and kept by `drop_leaks`; empty tables give an empty report.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from types import SimpleNamespace as Block  # plain data, so that a broadcast needs no class of this package

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.words import LOWER, Words, pieces

SPAN = 8
#: Positions that count; the first and the last always do.
MASKS = ((0, 2, 3, 5, 7), (0, 1, 4, 6, 7), (0, 2, 4, 5, 7), (0, 1, 3, 6, 7))
#: Length from which items are met by MASKS, and below which they must be a document's whole text.
LONG, WHOLE = 12, 5
WINDOW = 13
#: Hits that are laid side by side at once.
HITS = 1 << 18
SEPARATE = LOWER.copy()
for _c in range(0x21, 0x7F):
    if not chr(_c).isalnum():
        SEPARATE[_c] = 0x20
TABLE_BITS = 22


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, hashes, first): token hashes of runs of texts and where each text's begin."""
    for at, to, raw, bounds in pieces(column):
        w = Words(SEPARATE[raw], bounds, False)
        yield at, to, w.hashes(5), w.first - w.first[0]


def own_masks(n: int, similarity: float) -> list[tuple[int, ...]]:
    """Masks over the n tokens of a short item, one of which is equal in whatever has enough equal tokens."""
    apart = n - int(np.ceil(similarity * n - 1e-9))
    if not apart:
        return [tuple(range(n))]
    parts = [p.tolist() for p in np.array_split(np.arange(n), min(n, apart + 2))]
    return [tuple(a + b) for a, b in combinations(parts, 2)] if len(parts) == apart + 2 else [(k,) for k in range(n)]


def seeds(h: np.ndarray, mask: tuple[int, ...], span: int = SPAN) -> np.ndarray:
    """A hash at every position with `span` tokens from it on, whichever text they are of."""
    n = len(h) - span + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in mask:
        out = (out ^ h[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _inside(first: np.ndarray, n: int, span: int = SPAN) -> np.ndarray:
    """Which of n window starts have their whole window in one text."""
    ends = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + span <= ends


def block_of(ids: list, texts: list[str | None], similarity: float) -> Block:
    hs, counts = [np.zeros(0, np.uint64)], []
    for _, _, h, first in tokens(pa.array(texts, pa.string())):
        hs.append(h)
        counts.append(np.diff(first))
    h, count = np.concatenate(hs), np.concatenate(counts) if counts else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    families = []  # span, mask, sorted seeds, their places, and which leading bits of a seed there are
    for span in [0, *np.unique(count[(count > 0) & (count < LONG)]).tolist()]:
        for mask in own_masks(span, similarity) if span else MASKS:
            s = seeds(h, mask, span or SPAN)
            if span:
                at = first[:-1][count == span]
            else:
                at = np.flatnonzero(_inside(first, len(s)) & (np.repeat(count, count)[: len(s)] >= LONG))
            order = at[np.argsort(s[at], kind="stable")]
            table = np.zeros(1 << TABLE_BITS, bool)
            table[(s[order] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
            if len(order):
                families.append((span or SPAN, mask, s[order], order, np.packbits(table, bitorder="little")))
    return Block(ids=ids, h=h, first=first, families=families)


def blocks_of(benchmark: DataFrame, block_tokens: int, similarity: float) -> Iterator[Block]:
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator(prefetchPartitions=True):
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1] or "") // 2 + 1  # a token and its separator take two characters at least
        if size >= block_tokens:
            yield block_of(ids, texts, similarity)
            ids, texts, size = [], [], 0
    if ids:
        yield block_of(ids, texts, similarity)


def best_stretch(doc: np.ndarray, item: np.ndarray, shift: int, similarity: float) -> tuple[int, int, int] | None:
    """(start in the document, length, equal tokens) of the widest union of passing windows; None without one."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    size = min(len(item), WINDOW)
    if hi - lo < size or len(item) < WHOLE and len(doc) != len(item):
        return None
    same = doc[lo + shift : hi + shift] == item[lo:hi]
    run = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(run[size:] - run[:-size] >= np.ceil(similarity * size - 1e-9))
    if not len(good):
        return None
    a, b = int(good[0]), int(good[-1]) + size
    return lo + shift + a, b - a, int(run[b] - run[a])


def _hits(h: np.ndarray, first: np.ndarray, block: Block) -> Iterator[tuple[int, int, int]]:
    """(text, item, shift) of seed hits, HITS at a time: each comes once from a run of them."""
    for span, mask, keys, places, table in block.families:
        s = seeds(h, mask, span)
        head = s >> np.uint64(64 - TABLE_BITS)
        bit = table[(head >> np.uint64(3)).astype(np.int64)] >> (head & np.uint64(7)).astype(np.uint8) & 1
        maybe = np.flatnonzero(bit.astype(bool) & _inside(first, len(s), span))
        lo, hi = np.searchsorted(keys, s[maybe], "left"), np.searchsorted(keys, s[maybe], "right")
        maybe, lo, hit = maybe[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        ends = np.cumsum(hit)
        total = int(ends[-1]) if len(ends) else 0
        for at in range(0, total, HITS):
            n = np.arange(at, min(at + HITS, total))
            of = np.searchsorted(ends, n, "right")
            p, q = maybe[of], places[lo[of] + n - ends[of] + hit[of]]
            text = np.searchsorted(first, p, side="right") - 1
            item = np.searchsorted(block.first, q, side="right") - 1
            yield from np.unique(np.stack([text, item, (p - first[text]) - (q - block.first[item])], axis=1), axis=0).tolist()


def leaks_in(column: pa.Array, block: Block, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, length, equal): the best stretch of each row and item."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for at, _, h, first in tokens(column):
        for text, item, shift in _hits(h, first, block):
            got = best_stretch(h[first[text] : first[text + 1]], block.h[block.first[item] : block.first[item + 1]], shift, similarity)
            if got and (old := found.get((at + text, item), (0, 0, -1)))[2] < got[2] or got and got[2] == old[2] and got < old:
                found[at + text, item] = got
    return [(row, item, *got) for (row, item), got in sorted(found.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block_tokens: int = 500_000) -> DataFrame:
    """doc_id, item_id, start_word, n_words, n_equal: one row per document and item that it holds."""
    d = docs.select("doc_id", "text")
    id_kind, item_kind = d.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_kind.simpleString()}, item_id {item_kind}, start_word int, n_words int, n_equal int"

    def scan(block: Block) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(block)  # bounded by block_tokens

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = leaks_in(b.column(1), held.value, similarity)
                if got:
                    row, item, start, n, equal = zip(*got, strict=True)
                    yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array([held.value.ids[i] for i in item]), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(equal, pa.int32())], names=["doc_id", "item_id", "start_word", "n_words", "n_equal"])

        return d.mapInArrow(run, schema)

    found = [scan(b) for b in blocks_of(benchmark, block_tokens, similarity)] or [docs.sparkSession.createDataFrame([], schema)]
    all_found = reduce(DataFrame.unionByName, found)
    best = F.max(F.struct("n_equal", (-F.col("start_word")).alias("before"), "n_words")).alias("best")
    return all_found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.before")).alias("start_word"), "best.n_words", "best.n_equal")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block_tokens: int = 500_000) -> DataFrame:
    """The documents without leaks, with all of their columns: one scan per block, no shuffle."""
    text = docs.columns.index("text")
    for block in blocks_of(benchmark, block_tokens, similarity):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[x[0] for x in leaks_in(b.column(text), held.value, similarity)]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
