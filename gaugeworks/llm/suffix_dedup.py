"""Removal of repeated passages: every byte covered by a `length`-byte string that also starts in a document with a smaller doc_id.

Two equal strings have the same minimizer (the least hash of the SEED_BYTES-byte strings inside), so strings meet by minimizer:

1. Every document sends its minimizers to buckets; those that only one document has are dropped.
2. Stretches of strings that share a surviving minimizer go to that minimizer's bucket, equal stretches of one task once.
   A bucket's stretches form shards of up to SHARD_BYTES. Each shard gets a suffix array by Larsson-Sadakane refinement
   (groups are doubled in depth until they hold `length` bytes, sorted ones left alone) and common prefixes after Kasai, which give
   its distinct strings with the smallest doc_id of each. Shards of a bucket are merged by binary search.
3. Runs of strings that a smaller doc_id has go back to their documents, which are cut.

Steps 1 to 3 send packed arrays, one row per task and bucket, so the rows of a frequent string don't pile up.
Hash collisions in step 1 only cost work; strings are compared byte by byte in step 2.

Defined cases: null texts are empty; a null doc_id counts as smaller than all others; rows that share a doc_id never
cut each other, whether their texts are equal or not; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import stored
from gaugeworks.llm.words import pieces, xxh64

SEED_BYTES = 24
SHARD_BYTES = 2 << 20
#: Text bytes per bucket; the number of buckets follows the size of the input.
BUCKET_BYTES = 4 << 20
#: Strings of one stretch at most, so that periodic texts don't give stretches without end.
STRETCH = 64
ODD = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.zeros(0, np.int64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * ODD
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def stretches(raw: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, start, strings): runs of successive strings with one minimizer. start is a place in raw; key has 48 bits.

    raw has one separating byte after each text; no string holds one."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), EMPTY, EMPTY, EMPTY
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    grams = len(raw) - SEED_BYTES + 1
    h = np.zeros(grams, np.uint64)
    for j in range(0, SEED_BYTES, 8):
        h = (h ^ words[j : j + grams]) * ODD
        h ^= h >> np.uint64(32)
    wide, have = length - SEED_BYTES + 1, 1
    while have < wide:
        step = min(have, wide - have)
        h = np.minimum(h[: len(h) - step], h[step:])
        have += step
    # a string lies in one text if it ends before that text's separator
    end_of = np.repeat(bounds[1:] - 1, np.diff(bounds))[:n]
    inside = np.arange(n) + length <= end_of
    new = np.ones(n, bool)
    new[1:] = (h[1:] != h[:-1]) | (inside[1:] != inside[:-1])
    new[bounds[:-1][bounds[:-1] < n]] = True
    begin = np.flatnonzero(new)
    # long runs are cut into pieces
    size = np.diff(np.append(begin, n))
    parts = -(-size // STRETCH)
    of = np.repeat(np.arange(len(begin)), parts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = begin[of] + nth * STRETCH
    strings = np.minimum(size[of] - nth * STRETCH, STRETCH)
    keep = inside[start]
    start, strings = start[keep], strings[keep]
    return _mix(h[start]) >> np.uint64(16), np.searchsorted(bounds, start, side="right") - 1, start, strings


def part_of(doc: np.ndarray, parts: int) -> np.ndarray:
    """What `part_column` gives for these doc_ids."""
    at = np.arange(len(doc), dtype=np.int64) * 8
    raw = np.concatenate([doc.astype("<i8").view(np.uint8), np.zeros(8, np.uint8)])
    return np.mod(xxh64(raw, at, at + 8, 42).view(np.int64), parts)


def part_column(doc: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(parts).cast("long"))


def _groups(which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, rows with it), rows in order."""
    if not len(which):
        return
    order = np.argsort(which, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], which[order][1:] != which[order][:-1]]))
    for a, b in zip(begins, [*begins[1:], len(order)], strict=True):
        yield int(which[order[a]]), order[a:b]


def _packed(rows: list[tuple[int, list[np.ndarray]]]) -> pa.RecordBatch:
    """One row per bucket: the arrays' bytes, each behind its two lengths, compressed."""
    blobs = []
    for _, arrays in rows:
        parts = []
        for a in arrays:
            whole = a.tobytes()
            small = pa.compress(whole, codec="zstd", asbytes=True) if whole else b""
            parts += [len(whole).to_bytes(8, "little"), len(small).to_bytes(8, "little"), small]
        blobs.append(b"".join(parts))
    return pa.record_batch([pa.array([k for k, _ in rows], pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _unpacked(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        whole, small = int.from_bytes(blob[at : at + 8], "little"), int.from_bytes(blob[at + 8 : at + 16], "little")
        out.append(pa.decompress(blob[at + 16 : at + 16 + small], decompressed_size=whole, codec="zstd", asbytes=True) if small else b"")
        at += 16 + small
    return out


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Rows sorted by bucket, gathered."""
    now, held = None, []
    for b in batches:
        for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(_unpacked(blob))
    if held:
        yield now, held


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all places of text by their first `depth` bytes at least (zeros follow the text).

    Larsson-Sadakane: places start in groups of equal first 8 bytes; groups of more than one are sorted by the group of the place as
    many bytes further on as is known to agree, which doubles that depth; groups of one are left alone.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    first = np.ones(n, bool)
    first[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, np.int64)
    known = 8
    while True:
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, n))
        rank[order] = np.repeat(begin, size)
        if known >= depth or len(begin) == n:
            return order, rank
        open_slots = np.flatnonzero(np.repeat(size > 1, size))
        places = order[open_slots]
        ahead = places + known
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        both = (rank[places].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(both, kind="stable")
        order[open_slots] = places[by]
        both = both[by]
        first[open_slots[1:]] |= both[1:] != both[:-1]
        known *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, begin: np.ndarray, strings: np.ndarray, most: int) -> np.ndarray:
    """Bytes (up to most) that each place of `order` shares with the one before it, after Kasai.

    order: sorted places, those begin[i] + o with o < strings[i]. All stretches advance together, one place a step: what a place shares,
    the next one shares but for one byte with whatever stands before it, if the neighbour's next place is sorted before it.
    """
    n = len(order)
    at = np.full(len(text) + 1, -1, np.int64)
    at[order] = np.arange(n)
    words = np.ndarray((len(text),), "<u8", np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,))
    out = np.zeros(n, np.int64)
    live = np.arange(len(begin))
    have, mate = np.zeros(len(begin), np.int64), np.full(len(begin), -1, np.int64)
    for o in range(int(strings.max()) if len(strings) else 0):
        live = live[strings[live] > o]
        i = begin[live] + o
        r = at[i]
        follow = np.where(mate[live] >= 0, at[mate[live] + 1], -1)
        h = np.where((follow >= 0) & (follow < r), np.maximum(have[live] - 1, 0), 0)
        j = np.where(r > 0, order[np.maximum(r - 1, 0)], -1)
        go = np.flatnonzero(j >= 0)
        while len(go):
            x = words[np.minimum(i[go] + h[go], len(text) - 1)] ^ words[np.minimum(j[go] + h[go], len(text) - 1)]
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
            h[go] += same
            go = go[(same == 8) & (h[go] < most)]
        h = np.where(j >= 0, np.minimum(h, most), 0)
        out[r], have[live], mate[live] = h, h, j
    return out


def distinct_strings(text: np.ndarray, begin: np.ndarray, strings: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string class of every string in order of stretches, sorted distinct strings as bytes, smallest doc of each) of one shard."""
    order, _ = suffix_array(text, length)
    is_string = np.zeros(len(text), bool)
    total = int(strings.sum())
    nth = np.arange(total) - np.repeat(np.cumsum(strings) - strings, strings)
    places = np.repeat(begin, strings) + nth
    is_string[places] = True
    order = order[is_string[order]]
    new = common_prefixes(text, order, begin, strings, length) < length
    new[:1] = True
    kind = np.empty(len(text), np.int64)
    kind[order] = np.cumsum(new) - 1
    kind = kind[places]
    least = np.full(int(new.sum()), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, np.repeat(doc, strings))
    rows = np.lib.stride_tricks.sliding_window_view(text, length)[order[new]]
    return kind, np.ascontiguousarray(rows).view(f"V{length}").ravel(), least


def merge_shards(shards: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Lowers the smallest docs of strings that several shards have. Each shard: sorted strings, smallest docs (changed in place).

    Each shard is looked up in the union of those before it, which then takes it in; the union's minima go back in the end.
    """
    if len(shards) < 2:
        return
    strings, least = shards[0][0].view(f"S{shards[0][0].dtype.itemsize}"), shards[0][1].copy()
    for own, docs in shards[1:]:
        own = own.view(strings.dtype)
        place = np.searchsorted(strings, own)
        known = np.flatnonzero((place < len(strings)) & (strings[np.minimum(place, len(strings) - 1)] == own))
        np.minimum.at(least, place[known], docs[known])
        fresh = np.ones(len(own), bool)
        fresh[known] = False
        strings, least = np.insert(strings, place[fresh], own[fresh]), np.insert(least, place[fresh], docs[fresh])
    for own, docs in shards:
        docs[:] = least[np.searchsorted(strings, own.view(strings.dtype))]


def _bucket_spans(blobs: list[list[bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, place, size) of runs of bytes to cut, from one bucket's stretches. place holds the version in its upper bits."""
    texts, sizes, owner, docs, places, base = [], [], [], [], [], 0
    for size, text, which, doc, place in blobs:
        size = np.frombuffer(size, "<u2").astype(np.int64)
        sizes.append(size)
        texts.append(np.frombuffer(text, np.uint8))
        owner.append(np.frombuffer(which, "<u4").astype(np.int64) + base)
        docs.append(np.frombuffer(doc, "<i8"))
        places.append(np.frombuffer(place, "<i8"))
        base += len(size)
    size, text = np.concatenate(sizes), np.concatenate(texts)
    owner, doc, place = np.concatenate(owner), np.concatenate(docs), np.concatenate(places)
    begin = np.cumsum(size) - size
    # equal stretches of several tasks become one
    named = xxh64(np.concatenate([text, np.zeros(8, np.uint8)]), begin, begin + size, 1)
    _, head, same = np.unique(named, return_index=True, return_inverse=True)
    owner, begin, size = same[owner], begin[head], size[head]
    least = np.full(len(head), np.iinfo(np.int64).max)
    np.minimum.at(least, owner, doc)
    strings = size - length + 1
    first = np.concatenate([[0], np.cumsum(strings)])
    best = np.empty(int(first[-1]), np.int64)
    shards, kinds = [], []
    cut = np.searchsorted(np.cumsum(size), np.arange(SHARD_BYTES, int(size.sum()) + SHARD_BYTES, SHARD_BYTES)).tolist()
    cut = sorted({0, *(min(c, len(size)) for c in cut), len(size)})
    for a, b in zip(cut, cut[1:], strict=False):
        own = size[a:b]
        at = np.cumsum(own) - own
        joined = text[np.repeat(begin[a:b] - at, own) + np.arange(own.sum())]
        kind, rows, low = distinct_strings(joined, at, strings[a:b], least[a:b], length)
        shards.append((rows, low))
        kinds.append((first[a], first[b], kind))
    merge_shards(shards)
    for (x, y, kind), (_, low) in zip(kinds, shards, strict=True):
        best[x:y] = low[kind]
    lowest, highest = np.minimum.reduceat(best, first[:-1]), np.maximum.reduceat(best, first[:-1])
    whole = highest[owner] < doc
    out_doc, out_place, out_size = [doc[whole]], [place[whole]], [size[owner[whole]]]
    part = np.flatnonzero(~whole & (lowest[owner] < doc))
    for lo in range(0, len(part), 1 << 15):
        own = part[lo : lo + (1 << 15)]
        n = strings[owner[own]]
        row = np.repeat(np.arange(len(own)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        marked = best[first[owner[own]][row] + nth] < doc[own][row]
        edge = np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8))
        edge_row = np.concatenate([row, [-1]])
        turn = np.zeros(len(marked) + 1, bool)
        turn[1:-1] = row[1:] != row[:-1]
        on = np.flatnonzero((edge == 1) | turn & np.concatenate([marked, [False]]))
        off = np.flatnonzero((edge == -1) | turn & np.concatenate([[False], marked]))
        out_doc.append(doc[own][edge_row[on]])
        out_place.append(place[own][edge_row[on]] + nth[on])
        out_size.append(off - on + length - 1)
    return np.concatenate(out_doc), np.concatenate(out_place), np.concatenate(out_size)


def repeated_passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (pairs start, end), kept (bytes)."""
    if length < SEED_BYTES + 8:
        raise ValueError(f"length must be at least {SEED_BYTES + 8}")
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    lowest = F.lit(-(2**63)).cast("long")
    d = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), lowest).alias("doc"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text")), F.count(F.lit(1)), F.count_distinct("doc")).first()
    if size[1] != size[2]:  # rows share doc_ids: texts of one doc_id are told apart by a version
        version = F.dense_rank().over(Window.partitionBy("doc").orderBy("digest")) - 1
        versions = d.select("doc", F.sha1("text").alias("digest")).distinct().withColumn("version", version.cast("long"))
        d = d.withColumn("digest", F.sha1("text")).join(versions, ["doc", "digest"]).select("doc_id", "doc", "text", "version")
    else:
        d = d.withColumn("version", F.lit(0).cast("long"))
    buckets = 1 << max(4, int((size[0] or 0) // BUCKET_BYTES).bit_length())
    parts = buckets
    shift = np.uint64(48 - buckets.bit_length() + 1)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, owners, ids = [], [], b.column(0).to_numpy()
            for at, _, raw, bounds in pieces(b.column(1)):
                key, text, _, _ = stretches(raw, bounds, length)
                keys.append(key)
                owners.append(ids[at + text])
            key, doc = np.concatenate(keys), np.concatenate(owners)
            if len(key):
                low = (key & ((np.uint64(1) << shift) - np.uint64(1))).astype("<u8")
                yield _packed([(k, [low[rows].astype("<u4") if shift <= 32 else low[rows], np.diff(doc[rows], prepend=0).astype("<i8")]) for k, rows in _groups((key >> shift).astype(np.int64))])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _by_bucket(batches):
            low = np.concatenate([np.frombuffer(x[0], "<u4" if shift <= 32 else "<u8") for x in blobs])
            doc = np.concatenate([np.cumsum(np.frombuffer(x[1], "<i8")) for x in blobs])
            order = np.argsort(low, kind="stable")
            low, doc = low[order], doc[order]
            begin = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            many = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
            keep = np.repeat(many, np.diff(np.append(begin, len(low))))
            key = low[keep].astype(np.uint64) | (np.uint64(bucket) << shift)
            rows = [(k, [np.unique(key[own]).astype("<u8")]) for k, own in _groups(part_of(doc[keep], parts))]
            if rows:
                yield _packed(rows)

    blob = "bucket long, blob binary"
    found = d.select("doc", "text").mapInArrow(seen, blob).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared, blob)
    found = stored(found, "minimizers")

    texts = d.select(part_column(F.col("doc"), parts).alias("bucket"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("blob"), "doc_id", "doc", "version", "text")

    def beside(blobs: DataFrame) -> DataFrame:
        """Documents of a part behind the blobs sent to it."""
        none = [F.lit(None).cast(c) for c in (kind, "long", "long", "binary")]
        rows = blobs.select("bucket", F.lit(0).alias("kind"), "blob", *none).toDF(*texts.columns)
        return rows.unionByName(texts).repartition("bucket").sortWithinPartitions("bucket", "kind")

    def take_blobs(b: pa.RecordBatch, held: dict[int, list[list[bytes]]]) -> pa.RecordBatch:
        """Moves blobs into held (only the last bucket's stay) and returns the documents."""
        is_text = b.column(1).to_numpy() == 1
        for bucket, x in zip(b.column(0).to_numpy()[~is_text].tolist(), b.column(2).filter(pa.array(~is_text)).to_pylist(), strict=True):
            held.setdefault(bucket, []).append(_unpacked(x))
        return b.filter(pa.array(is_text))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        wanted: dict[int, np.ndarray] = {}
        for b in batches:
            b = take_blobs(b, held)
            bucket = b.column(0).to_numpy()
            for part, rows in _groups(bucket):
                if part in held:
                    wanted[part] = np.unique(np.concatenate([np.frombuffer(x[0], "<u8") for x in held.pop(part)]))
                own = b.take(pa.array(rows))
                if part in wanted:
                    yield from stretches_of(own, wanted[part])
            last = int(bucket[-1]) if len(bucket) else None
            wanted = {k: v for k, v in wanted.items() if k == last}
            if last is not None:
                held = {k: v for k, v in held.items() if k >= last}

    def stretches_of(b: pa.RecordBatch, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, version = b.column(4).to_numpy(), b.column(5).to_numpy()
        for at, _, raw, bounds in pieces(b.column(6), 4 << 20):
            key, text, start, strings = stretches(raw, bounds, length)
            place = np.searchsorted(wanted, key)
            some = np.flatnonzero(wanted[np.minimum(place, len(wanted) - 1)] == key) if len(wanted) else EMPTY
            key, text, start, size = key[some], text[some], start[some], strings[some] + length - 1
            if not len(key):
                continue
            # equal stretches once; the minimizer is part of the name, so they meet in one bucket
            name = xxh64(np.concatenate([raw, np.zeros(8, np.uint8)]), start, start + size, 1) ^ _mix(key)
            _, head, same = np.unique(name, return_index=True, return_inverse=True)
            doc = ids[at + text]
            where = (start - bounds[text]) | (version[at + text] << 40)
            bucket_of = (key[head] >> shift).astype(np.int64)
            rows = []
            own_rows = dict(_groups(bucket_of[same]))
            number = np.empty(len(head), np.int64)
            for bucket, heads in _groups(bucket_of):
                number[heads] = np.arange(len(heads))
                n = size[head[heads]]
                packed = raw[np.repeat(start[head[heads]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                occ = own_rows[bucket]
                rows.append((bucket, [n.astype("<u2"), packed, number[same[occ]].astype("<u4"), doc[occ].astype("<i8"), where[occ].astype("<i8")]))
            yield _packed(rows)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_bucket(batches):
            doc, place, n = _bucket_spans(blobs, length)
            if len(doc):
                yield _packed([(k, [doc[own].astype("<i8"), place[own].astype("<i8"), n[own].astype("<i4")]) for k, own in _groups(part_of(doc, parts))])

    spans = beside(found).mapInArrow(send, blob).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(decide, blob)
    spans = stored(spans, "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        ready: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in batches:
            b = take_blobs(b, held)
            bucket = b.column(0).to_numpy()
            for part, rows in _groups(bucket):
                if part in held:
                    blobs = held.pop(part)
                    doc, place, n = (np.concatenate([np.frombuffer(x[i], t) for x in blobs]) for i, t in ((0, "<i8"), (1, "<i8"), (2, "<i4")))
                    order = np.argsort(doc, kind="stable")
                    ready[part] = doc[order], place[order], n[order]
                own = b.take(pa.array(rows))
                doc, place, n = ready.get(part, (EMPTY, EMPTY, EMPTY))
                out = []
                ids, versions = own.column(4).to_numpy(), own.column(5).to_numpy()
                lo, hi = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
                for i in range(own.num_rows):
                    text = own.column(6)[i].as_buffer()
                    a = slice(lo[i], hi[i])
                    mine = (place[a] >> 40) == versions[i]
                    out.append(_cut(np.frombuffer(text, np.uint8) if len(text) else np.zeros(0, np.uint8), (place[a] & ((1 << 40) - 1))[mine], n[a][mine]))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.record_batch([own.column(3), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3]), pa.array(cols[4], pa.list_(pa.int64())), pa.array(cols[5], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
            last = int(bucket[-1]) if len(bucket) else None
            ready = {k: v for k, v in ready.items() if k == last}
            if last is not None:
                held = {k: v for k, v in held.items() if k >= last}

    return beside(spans).mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary")


def _cut(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[int, int, int, str, list[int], bytes]:
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + size, -1)
    gone = np.cumsum(cover)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    kept = text[~gone].tobytes()
    return len(text), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge.tolist(), kept
