"""A content-addressed store of token ids.

Layout below one folder, all Parquet:

  first/kind=1   digest, width, payload: each unique chunk once; payload is its ids, little-endian, `width` bytes each
  store/kind=0   shard, slot, doc_id, start, n_tokens, chunks, sizes, root: one recipe per document, in ascending doc_id
                 order over shards and slots; chunks is the digests of its chunks, 16 bytes each, sizes their ids as
                 little-endian u32, start the ids of the documents before it in its shard, root a Merkle root
  store/kind=1   shard, slot (number of documents), n_tokens, root: the manifest, a Merkle root over each shard's documents

Ids are cut by content: a rolling hash over WINDOW ids ends a chunk where its top bits are zero, so equal passages of two documents give
equal chunks wherever they stand. A chunk's digest is BLAKE2b-128 over its ids as u32. Reading back checks every payload
against its digest, every recipe against its root and its length, and every shard against the manifest.

Defined cases: null texts are empty (the end id alone); null doc_ids come first; repeated rows and doc_ids are documents
of their own; extra columns are left out; an empty table gives an empty store and no rows.
"""

from __future__ import annotations

import hashlib
import sys
import types
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import drop_scratch, files_freed
from gaugeworks.llm.words import SPACE, texts_of

WINDOW, LEAST, MOST, CUT_BITS = 16, 32, 2048, 8
MIX = np.uint64(0x9E3779B97F4A7C15)
#: The low n bytes of eight.
BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Units whose ids a worker remembers, and how many bytes of them.
REMEMBERED, REMEMBERED_BYTES = 1 << 20, 1 << 24
#: Bytes of a unit that is looked up as two numbers; longer ones are looked up as bytes.
SHORT = 15
BATCH_BYTES = 1 << 20
#: New units encoded as one text.
TOGETHER = 64
#: Marks between letters and which a unit ends (others may belong to a contraction).
MARKS = np.zeros(256, bool)
MARKS[list(b".,;:!?#$%&*|<>\"()")] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: First bytes of white space beyond ASCII, of which texts are encoded whole: U+0085, U+00A0, U+1680, U+2000-U+205F, U+3000.
WIDE = np.zeros(256, bool)
WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def unit_bounds(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where units begin in texts raw[bounds[i]:bounds[i + 1]], and the end. A run of white space is a unit but for its last
    character, which is one of its own or, if it's a space, the first of the next unit; letters end before a mark."""
    n = len(raw)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    space = SPACE[raw]
    begin = first.copy()
    if n > 1:
        here, before = space[1:], space[:-1]
        last = np.append(~space[2:] & ~first[2:n], False)  # a word of the same text follows
        letter = LETTER[raw]
        letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)  # Latin letters of two bytes
        begin[1:n] |= (here & (~before | last)) | (~here & before & (raw[:-1] != 0x20)) | (MARKS[raw[1:]] & letter[:-1])
    return np.flatnonzero(begin)


def has_wide_space(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts may hold white space beyond ASCII."""
    at = np.flatnonzero(WIDE[raw])
    one, two, three = raw[at], np.append(raw, [0, 0])[at + 1], np.append(raw, [0, 0])[at + 2]
    wide = (one == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (one == 0xE1) & (two == 0x9A) | (one == 0xE2) & ((two == 0x80) | (two == 0x81)) & ((three <= 0x8A) | (three >= 0x9F)) | (one == 0xE3) & (two == 0x80) & (three == 0x80)
    out = np.zeros(len(bounds) - 1, bool)
    out[np.searchsorted(bounds, at[wide], "right") - 1] = True
    return out


class UnitEncoder:
    """Encodes texts as the tokenizer does, remembering the ids of units.

    Byte-level pre-tokenization splits at all places where units end: it never joins what stands before white space with
    what follows, gives the last space of white space to the word behind it, and splits letters from punctuation. So a
    text's ids are those of its units one after another. New units are encoded as lines of one text: a line feed is a
    token of its own before any unit without one. Texts with white space beyond ASCII or with an added token of the
    tokenizer are encoded whole.

    Units of up to SHORT bytes are looked up, many at once, in an open-addressing table: two numbers hold a unit's bytes and
    length, so no two units are taken for each other.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.feed = self.ids_of(["\n"])[0]
        self.forget()

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        self.table = np.full(1 << 22, -1, np.int32)  # unit numbers; never over a third full
        self.keys = np.zeros((2, 1 << 14), np.uint64)  # of unit i; longer units have none
        self.long: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)  # where unit i's ids end; they begin where those of i - 1 end
        self.learnt = self.held = 0

    def learn(self, units: list[bytes]) -> None:
        """The ids of new units, which get the next numbers."""
        units = [u.decode() for u in units]
        lines = [i for i, u in enumerate(units) if not u.isspace()] if len(self.feed) == 1 else []
        sizes, held = np.zeros(len(units), np.int64), {}
        runs = [lines[i : i + TOGETHER] for i in range(0, len(lines), TOGETHER)]
        got = self.ids_of(["\n" + "\n".join(units[i] for i in run) for run in runs])
        parts = []
        for run, ids in zip(runs, got, strict=True):
            ids = np.array(ids, np.uint32)
            feeds = np.flatnonzero(ids == self.feed[0])
            if len(feeds) != len(run):
                parts += self.ids_of([units[i] for i in run])
                sizes[run] = [len(x) for x in parts[-len(run) :]]
                continue
            parts.append(np.delete(ids, feeds))
            sizes[run] = np.diff(np.append(feeds, len(ids))) - 1
        mine = set(lines)
        rest = [i for i in range(len(units)) if i not in mine]
        for i, ids in zip(rest, self.ids_of([units[i] for i in rest]), strict=True):
            held[i] = ids
            sizes[i] = len(ids)
        n, used = self.learnt, int(self.at[self.learnt - 1]) if self.learnt else 0
        ends = used + np.cumsum(sizes)
        while len(units) and ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(units) > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)], axis=1)
        begins = ends - sizes
        if lines:
            own = sizes[lines]
            self.flat[np.repeat(begins[lines] - np.cumsum(own) + own, own) + np.arange(own.sum())] = np.concatenate(parts)
        for i, ids in held.items():
            self.flat[begins[i] : ends[i]] = ids
        self.at[n : n + len(units)] = ends
        self.learnt += len(units)
        self.held += sum(map(len, units))

    def look_up(self, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each short unit, or -1 and the slot where it belongs."""
        slot = (((head ^ (tail * MIX)) * MIX) >> np.uint64(42)).astype(np.int64)
        found, left = np.full(len(head), -1, np.int64), np.arange(len(head))
        while len(left):
            unit = self.table[slot[left]]
            left, unit = left[unit >= 0], unit[unit >= 0]
            same = (self.keys[0, unit] == head[left]) & (self.keys[1, unit] == tail[left])
            found[left[same]] = unit[same]
            left = left[~same]
            slot[left] = (slot[left] + 1) & (len(self.table) - 1)
        return found, slot

    def numbers(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of every unit raw[begins:ends]; new ones are learnt. raw goes on for 16 bytes."""
        which, size = np.empty(len(begins), np.int64), ends - begins
        few = np.flatnonzero(size <= SHORT)
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        own = size[few]
        head, tail = eight[begins[few]] & BYTES[np.minimum(own, 8)], eight[begins[few] + 8] & BYTES[np.maximum(own - 8, 0)]
        tail |= own.astype(np.uint64) << np.uint64(56)
        which[few], slot = self.look_up(head, tail)
        unknown = np.flatnonzero(which[few] < 0)
        if len(unknown):
            order = unknown[np.lexsort((tail[unknown], head[unknown]))]
            new = np.ones(len(order), bool)
            new[1:] = (head[order[1:]] != head[order[:-1]]) | (tail[order[1:]] != tail[order[:-1]])
            one, nth = order[new], np.cumsum(new) - 1
            numbers = self.learnt + np.arange(len(one))
            which[few[order]] = numbers[nth]
            at = few[one]
            data = raw.tobytes()
            self.learn([data[a:b] for a, b in zip(begins[at].tolist(), ends[at].tolist(), strict=True)])
            self.keys[0, numbers], self.keys[1, numbers] = head[one], tail[one]
            place, left = slot[one], np.arange(len(one))
            while len(left):  # of those that want one slot, one gets it and the others go on
                free = left[self.table[place[left]] < 0]
                self.table[place[free]] = numbers[free]
                left = left[self.table[place[left]] != numbers[left]]
                place[left] = (place[left] + 1) & (len(self.table) - 1)
        many = np.flatnonzero(size > SHORT)
        if len(many):
            fresh: list[bytes] = []
            for i, a, b in zip(many.tolist(), begins[many].tolist(), ends[many].tolist(), strict=True):
                unit = raw[a:b].tobytes()
                number = self.long.get(unit, -1)
                if number < 0:
                    self.long[unit] = number = self.learnt + len(fresh)
                    fresh.append(unit)
                which[i] = number
            self.learn(fresh)
        return which

    def encode(self, raw: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts raw[bounds[i]:bounds[i + 1]], the end id after each text, and where each text's ids begin and
        the last end."""
        if self.learnt > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.forget()
        whole = has_wide_space(raw, bounds)
        data = raw.tobytes()
        for token in self.added:
            at = data.find(token)
            while at >= 0:  # one that two texts make up only costs time
                whole[np.searchsorted(bounds, at, "right") - 1] = True
                at = data.find(token, at + 1)
        begins = unit_bounds(raw, bounds)
        begins, ends = begins[:-1], begins[1:]
        text = np.searchsorted(bounds, begins, "right") - 1
        if whole.any():
            keep = ~whole[text]
            begins, ends, text = begins[keep], ends[keep], text[keep]
        which = self.numbers(np.append(raw, np.zeros(16, np.uint8)), begins, ends)
        first = np.where(which > 0, self.at[which - 1], 0)
        sizes = self.at[which] - first
        ids = self.flat[np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        per_text = np.bincount(text, weights=sizes, minlength=len(whole)).astype(np.int64)
        stops = np.cumsum(per_text)
        out = np.insert(ids, stops, np.uint32(end_id)) if len(whole) else ids
        stops = np.concatenate([[0], stops + np.arange(1, len(stops) + 1)])
        if whole.any():
            odd = np.flatnonzero(whole).tolist()
            direct = dict(zip(odd, self.ids_of([data[bounds[i] : bounds[i + 1]].decode() for i in odd]), strict=True))
            parts = [np.array([*direct[i], end_id], np.uint32) if i in direct else out[stops[i] : stops[i + 1]] for i in range(len(whole))]
            out, stops = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return out, stops


def encoder_of(spec: str) -> UnitEncoder:
    """The worker process's encoder: it outlives tasks, which bring this module's functions along by value."""
    held = sys.modules.setdefault("_gaugeworks_worker", types.ModuleType("_gaugeworks_worker"))
    if getattr(held, "spec", None) != spec:
        held.spec, held.encoder = spec, UnitEncoder(spec)
    return held.encoder


def cuts(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks end, and how many each text has. No chunk is over MOST long or crosses texts."""
    t = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = t ^ (t >> np.uint64(31))
    step, factor = 1, 0xD6E8FEB86659FD93
    while step < WINDOW:
        part = h.copy()
        if step < len(h):
            part[step:] += np.uint64(factor) * h[:-step]
        h, factor, step = part, factor * factor % (1 << 64), 2 * step
    places = np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + 1
    lo = np.searchsorted(places, bounds[:-1], "right").tolist()
    hi = np.searchsorted(places, bounds[1:], "left").tolist()
    places, out, counts = places.tolist(), [], []
    for a, b, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), lo, hi, strict=True):
        before = len(out)
        for c in (*places[i:j], b):
            while c - a > MOST:
                a += MOST
                out.append(a)
            if c - a >= LEAST or c == b and c > a:
                out.append(c)
                a = c
        counts.append(len(out) - before)
    return np.array(out, np.int64), np.array(counts, np.int64)


def merkle(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level, an odd last one goes up as it is; no leaves give zeros."""
    if not leaves:
        return bytes(16)
    while len(leaves) > 1:
        up = [hashlib.blake2b(leaves[i] + leaves[i + 1], digest_size=16, person=b"node").digest() for i in range(0, len(leaves) - 1, 2)]
        leaves = up + leaves[len(leaves) - len(leaves) % 2 :]
    return leaves[0]


def _split(b: bytes) -> list[bytes]:
    return [b[i : i + 16] for i in range(0, len(b), 16)]


POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product modulo the CRC-32 polynomial, bits reflected."""
    out, b = np.zeros_like(b), b.copy()
    for i in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(i) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), POLY, np.uint32(0))
    return out


def _times_by(power: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_times(power, b) for one power: the product is linear in b, so a table for each byte of b does."""
    values = np.arange(256, dtype=np.uint32)
    out = np.zeros_like(b)
    for shift in np.array([0, 8, 16, 24], np.uint32):
        out ^= _times(np.broadcast_to(power, 256), values << shift)[(b >> shift) & np.uint32(255)]
    return out


def crc_before(crc: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What a CRC-32 contributes to that of a longer text, with so many 4-byte words after its own part."""
    out, left = crc.astype(np.uint32), words.astype(np.int64)
    power = np.array([1 << 30], np.uint32)  # x
    for _ in range(5):
        power = _times(power, power)  # x^32: one word
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _times_by(power, out[odd])
        power, left = _times(power, power), left >> 1
    return out


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encodes docs and writes the store below path. tokenizer: path of a byte-level BPE file of the tokenizers library."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(Path(tokenizer).read_text())  # one vocabulary file
    d = docs.select("doc_id", "text")
    id_kind = d.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = encoder_of(spec.value), set()
        for b in batches:
            ids_of = b.column(0)
            for at, to, raw, bounds in texts_of(b.column(1), BATCH_BYTES):
                ids, bounds = encoder.encode(raw, bounds, end_id)
                ends, counts = cuts(ids, bounds)
                begins = np.concatenate([[0], ends[:-1]])
                wide = ids.astype("<u4").tobytes()
                width = 2 if len(ids) and ids.max() < 1 << 16 else 4
                small = ids.astype("<u2").tobytes() if width == 2 else wide
                digests = [hashlib.blake2b(wide[4 * a : 4 * e], digest_size=16).digest() for a, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                fresh = {}
                for i, x in enumerate(digests):
                    if x not in seen and x not in fresh:
                        fresh[x] = small[width * int(begins[i]) : width * int(ends[i])]
                if len(seen) < 1 << 20:
                    seen.update(fresh)
                first = np.concatenate([[0], np.cumsum(counts)]).tolist()
                sizes = (ends - begins).astype("<u4")
                n, m = to - at, len(fresh)
                recipes = [b"".join(digests[first[i] : first[i + 1]]) for i in range(n)]
                yield pa.record_batch(
                    [
                        pa.array(np.repeat([0, 1], [n, m]).astype(np.int32)),
                        pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in recipes] + list(fresh), pa.binary()),
                        pa.concat_arrays([ids_of.slice(at, n), pa.nulls(m, ids_of.type)]),
                        pa.array([*np.diff(bounds).tolist(), *[width] * m], pa.int64()),
                        pa.array(recipes + [None] * m, pa.binary()),
                        pa.array([sizes[first[i] : first[i + 1]].tobytes() for i in range(n)] + list(fresh.values()), pa.binary()),
                    ],
                    names=["kind", "key", "doc_id", "n", "chunks", "body"],
                )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # equal keys follow each other
        for b in batches:
            if not b.num_rows:
                continue
            chunk, keys = b.column(0).to_numpy() == 1, b.column(1)
            new = np.ones(b.num_rows, bool)
            new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            new[0] = keys[0].as_py() != last
            last = keys[-1].as_py()
            yield b.filter(pa.array(new | ~chunk))

    rows = f"kind int, key binary, doc_id {id_kind}, n long, chunks binary, body binary"
    # each task sends a chunk once, so even a chunk of every document comes as often as there are tasks
    first = d.mapInArrow(encode, rows).repartition("key").sortWithinPartitions("kind", "key").mapInArrow(once, rows)
    with files_freed(spark):
        first.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/first")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, slot, start, roots = TaskContext.get().partitionId(), 0, 0, []
        names = ["kind", "shard", "slot", "doc_id", "start", "n_tokens", "chunks", "sizes", "root"]
        kind = None
        for b in batches:
            kind, n = b.column(0).type, b.num_rows
            own = [merkle(_split(x)) for x in b.column(2).to_pylist()]
            roots += own
            tokens = b.column(1).to_numpy()
            starts = start + np.cumsum(tokens) - tokens
            yield pa.record_batch([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(slot, slot + n)), b.column(0), pa.array(starts), b.column(1), b.column(2), b.column(3), pa.array(own, pa.binary())], names=names)
            slot, start = slot + n, start + int(tokens.sum())
        if slot:
            yield pa.record_batch([pa.array([1], pa.int32()), pa.array([shard], pa.int32()), pa.array([slot], pa.int64()), pa.nulls(1, kind), pa.array([0], pa.int64()), pa.array([start], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([merkle(roots)], pa.binary())], names=names)

    recipes = _first(spark, path, id_kind).where("kind = 0").select("doc_id", F.col("n").alias("n_tokens"), "chunks", F.col("body").alias("sizes"))
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    ordered = recipes.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "chunks")
    numbered = ordered.mapInArrow(number, f"kind int, shard int, slot long, doc_id {id_kind}, start long, n_tokens long, chunks binary, sizes binary, root binary")
    with files_freed(spark):
        numbered.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/store")
    drop_scratch(spark, f"{path}/first/kind=0")


def _first(spark: SparkSession, path: str, id_kind: str) -> DataFrame:
    return spark.read.schema(f"key binary, doc_id {id_kind}, n long, chunks binary, body binary, kind int").parquet(f"{path}/first")


def _store(spark: SparkSession, path: str, id_kind: str) -> DataFrame:
    return spark.read.schema(f"shard int, slot long, doc_id {id_kind}, start long, n_tokens long, chunks binary, sizes binary, root binary, kind int").parquet(f"{path}/store")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """digest, width, payload of every stored chunk."""
    return _first(spark, path, "long").where("kind = 1").select(F.col("key").alias("digest"), F.col("n").cast("int").alias("width"), F.col("body").alias("payload"))


def read_store(spark: SparkSession, path: str, id_kind: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks from the files, everything checked on the way.

    Payloads are decoded where they lie; only a digest, a length and a CRC of each travel to the recipes, and CRCs of
    chunks combine to those of documents by XOR.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, crcs = b.column(0).to_pylist(), [], []
            for x, width, payload in zip(digests, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                wide = payload if width == 4 else np.frombuffer(payload, "<u2").astype("<u4").tobytes()
                if hashlib.blake2b(wide, digest_size=16).digest() != x:
                    raise ValueError(f"chunk {x.hex()} doesn't match its digest")
                sizes.append(len(wide) // 4)
                crcs.append(zlib.crc32(wide))
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["digest", "held", "crc"])

    def references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [_split(x) for x in b.column("chunks").to_pylist()]
            for x, root in zip(lists, b.column("root").to_pylist(), strict=True):
                if merkle(x) != root:
                    raise ValueError("a recipe doesn't match its root")
            counts = np.array([len(x) for x in lists], np.int64)
            sizes = np.frombuffer(b"".join(b.column("sizes").to_pylist()), "<u4").astype(np.int64)
            ends, total = np.cumsum(sizes), b.column("n_tokens").to_numpy()
            row = np.repeat(np.arange(len(lists)), counts)
            before = np.concatenate([[0], ends])[np.cumsum(counts) - counts]
            after = total[row] - (ends - before[row])
            if (np.bincount(row, weights=sizes, minlength=len(lists)).astype(np.int64) != total).any():
                raise ValueError("a recipe's chunks don't add up to its length")
            take = pa.array(row)
            yield pa.record_batch([*(b.column(c).take(take) for c in ("shard", "slot", "doc_id", "start", "n_tokens")), pa.array([y for x in lists for y in x], pa.binary()), pa.array(sizes), pa.array(after)], names=["shard", "slot", "doc_id", "start", "n_tokens", "chunk", "size", "after"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = crc_before(b.column("crc").to_numpy(), b.column("after").to_numpy()).astype(np.int64)
            yield pa.record_batch([*(b.column(c) for c in ("shard", "slot", "doc_id", "start", "n_tokens")), pa.array(part)], names=["shard", "slot", "doc_id", "start", "n_tokens", "part"])

    store = _store(spark, path, id_kind)
    # one row per shard
    manifest = sorted((r["shard"], r["n_tokens"], r["slot"]) for r in store.where("kind = 1").select("shard", "n_tokens", "slot").collect())
    starts = [0] * (manifest[-1][0] + 1 if manifest else 1)
    total = 0
    for shard, n, _ in manifest:
        starts[shard], total = total, total + n
    key = f"shard int, slot long, doc_id {id_kind}, start long, n_tokens long"
    refs = store.where("kind = 0").drop("kind").mapInArrow(references, f"{key}, chunk binary, size long, after long")
    chunks = read_chunks(spark, path).mapInArrow(decode, "digest binary, held long, crc long")
    met = refs.join(chunks, refs["chunk"] == chunks["digest"], "left").withColumn("crc", F.when((F.col("held") == F.col("size")), F.col("crc")).otherwise(F.raise_error(F.lit("a chunk is missing or has another length")).cast("long")))
    parts = met.select("shard", "slot", "doc_id", "start", "n_tokens", "crc", "after").mapInArrow(combine, f"{key}, part long")
    whole = parts.groupBy("shard", "slot", "doc_id", "start", "n_tokens").agg(F.bit_xor("part").alias("ids_crc32"), F.count(F.lit(1)).alias("n_chunks"))
    return whole.select("doc_id", (F.element_at(F.lit(starts), F.col("shard") + 1) + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "n_chunks")


def verify_manifest(spark: SparkSession, path: str, id_kind: str = "bigint") -> DataFrame:
    """shard, ok: whether a shard's documents, in order, give the manifest's root, count and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots: dict[int, tuple[list[bytes], int]] = {}
        for b in batches:
            for shard, n, root in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                own, tokens = roots.get(shard, ([], 0))
                own.append(root)
                roots[shard] = own, tokens + n
        yield pa.record_batch([pa.array(list(roots), pa.int32()), pa.array([merkle(x) for x, _ in roots.values()], pa.binary()), pa.array([len(x) for x, _ in roots.values()], pa.int64()), pa.array([n for _, n in roots.values()], pa.int64())], names=["shard", "got", "rows", "tokens"])

    store = _store(spark, path, id_kind)
    got = store.where("kind = 0").select("shard", "slot", "n_tokens", "root").repartition("shard").sortWithinPartitions("shard", "slot").mapInArrow(run, "shard int, got binary, rows long, tokens long")
    said = store.where("kind = 1").select(F.col("shard").alias("s"), F.col("slot").alias("n"), F.col("n_tokens").alias("t"), "root")
    return said.join(got, said["s"] == got["shard"], "full").select(F.coalesce("s", "shard").alias("shard"), F.coalesce((F.col("got") == F.col("root")) & (F.col("rows") == F.col("n")) & (F.col("tokens") == F.col("t")), F.lit(False)).alias("ok"))


def read_ids(spark: SparkSession, path: str, id_kind: str = "bigint") -> DataFrame:
    """doc_id, shard, slot, ids: every document's ids, put together from its chunks."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.concatenate([np.frombuffer(p["payload"], "<u2" if p["width"] == 2 else "<u4").astype(np.int64) for p in parts]) for parts in b.column(3).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "shard", "slot", "ids"])

    refs = _store(spark, path, id_kind).where("kind = 0").select("doc_id", "shard", "slot", F.posexplode(F.expr("transform(sequence(0, length(chunks) div 16 - 1), i -> substring(chunks, i * 16 + 1, 16))")).alias("pos", "digest"))
    parts = refs.join(read_chunks(spark, path), "digest").groupBy("doc_id", "shard", "slot").agg(F.array_sort(F.collect_list(F.struct("pos", "width", "payload"))).alias("parts"))
    return parts.mapInArrow(join, f"doc_id {id_kind}, shard int, slot long, ids array<long>")
