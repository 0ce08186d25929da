"""Quality rules by distribution divergence, on top of simple base counts.

A language's reference holds two histograms summed over all of its documents: classes of characters, and its most common
words (whole words of any length and script, A-Z lower-cased) against all other words. A document is rejected if its
Jensen-Shannon distance (base 2, 0 to 1) to its language's reference is above a limit, for characters or for words, each
judged only from a minimum length on. Every language has its own reference, however many languages there are: references
are a table, which is joined to the documents.

Defined cases: null and blank texts have no words and fail the base rule; a null language is a language of its own;
repeated rows and null doc_ids are rows like any other; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import stored
from gaugeworks.llm.words import LOWER, SPACE, Words, pieces, xxh64

#: Different words whose counts a task holds before it passes them on; as many again wait to be added. A worker copies them
#: several times over, and an executor has as many workers as cores.
HELD = 1 << 17
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "line feed", "stop", "mark", "symbol", "other", "non-ASCII")
CLASS_OF = np.full(256, 8, np.uint8)
CLASS_OF[0x61:0x7B], CLASS_OF[0x41:0x5B], CLASS_OF[0x30:0x3A] = 0, 1, 2
CLASS_OF[SPACE] = 3
CLASS_OF[0x0A] = 4
CLASS_OF[list(b".,")], CLASS_OF[list(b";:!?'\"-()")], CLASS_OF[list(SYMBOLS)] = 5, 6, 7
CLASS_OF[0xC0:] = 9
CLASS_OF[0x80:0xC0] = 10  # goes on with a character that was counted
SYMBOL = np.zeros(256, bool)
SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Limits:
    characters: float = 0.32
    words: float = 0.48
    least_characters: int = 200
    least_words: int = 40
    common: int = 32


def class_counts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Characters of each class per text (the line feed after each text is not counted)."""
    n = len(bounds) - 1
    out = np.bincount(np.repeat(np.arange(n, dtype=np.int64) * 11, np.diff(bounds)) + CLASS_OF[raw], minlength=11 * n).reshape(n, 11)[:, :10]
    out[:, 4] -= 1
    return out


def lower_hashes(w: Words) -> np.ndarray:
    """A hash of every lower-cased word (64 bits stand for a word)."""
    return xxh64(LOWER[w.buf], w.start, w.end, 11)


def _summed(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(language, hash, count, word) with one row per language and hash."""
    lang, h, n = (np.concatenate([x[k] for x in parts]) for k in range(3))
    word = pa.concat_arrays([x[3] for x in parts])
    order = np.lexsort((h, lang))
    new = np.ones(len(order), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (lang[order[1:]] != lang[order[:-1]])
    begins = np.flatnonzero(new)
    first = order[begins]
    return lang[first], h[first], np.add.reduceat(n[order], begins) if len(begins) else n, word.take(pa.array(first))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one task's texts (columns lang, text): lang, kind (0 classes, 1 words, 2 all words), code, word, n."""
    names: dict[str | None, int] = {}
    classes: dict[int, np.ndarray] = {}
    words: dict[int, int] = {}
    held: list[tuple] = []
    waiting = 0

    def rows(lang: list, kind: int, code: list, word: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        own = list(names)
        return pa.record_batch([pa.array([own[x] for x in lang], pa.string()), pa.array(np.full(len(n), kind, np.int32)), pa.array(code, pa.int32()), word, pa.array(n, pa.int64())], names=["lang", "kind", "code", "word", "n"])

    def passed_on() -> Iterator[pa.RecordBatch]:
        lang, _, n, word = held[0]
        for at in range(0, len(n), 1 << 15):
            part = slice(at, at + (1 << 15))
            yield rows(lang[part].tolist(), 1, [0] * len(n[part]), word[part], n[part])

    for b in batches:
        langs = b.column(0).to_pylist()
        for at, to, raw, bounds in pieces(b.column(1)):
            counts, w = class_counts(raw, bounds), Words(raw, bounds, True)
            of = np.array([names.setdefault(x, len(names)) for x in langs[at:to]])
            for x in np.unique(of).tolist():
                classes[x] = classes.get(x, 0) + counts[of == x].sum(axis=0)
                words[x] = words.get(x, 0) + int(w.count[of == x].sum())
            size = w.end - w.start
            h, lang = xxh64(w.buf, w.start, w.end, 11), of[w.of()]
            order = np.lexsort((h, lang))
            new = np.ones(len(order), bool)
            new[1:] = (h[order[1:]] != h[order[:-1]]) | (lang[order[1:]] != lang[order[:-1]])
            begins = np.flatnonzero(new)
            if not len(begins):
                continue
            one, size = order[begins], size[order[begins]]
            ends = np.cumsum(size)
            data = w.buf[np.repeat(w.start[one] - ends + size, size) + np.arange(ends[-1])]
            word = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data)])
            held.append((lang[one], h[one], np.diff(np.append(begins, len(order))), word))
            waiting += len(one)
            if waiting > HELD:
                held, waiting = [_summed(held)], 0
                if len(held[0][1]) > HELD:
                    yield from passed_on()
                    held = []
    if held:
        held = [_summed(held)]
        yield from passed_on()
    for x, c in classes.items():
        yield rows([x] * 10, 0, list(range(10)), pa.nulls(10, pa.binary()), c)
    if words:
        yield rows(list(words), 2, [0] * len(words), pa.nulls(len(words), pa.binary()), np.array(list(words.values())))


def _reference_counts(docs: DataFrame) -> DataFrame:
    """The same, added up over all tasks."""
    found = docs.select(F.col("lang").cast("string"), "text").mapInArrow(counted, "lang string, kind int, code int, word binary, n long")
    return found.groupBy("lang", "kind", "code", "word").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, limits: Limits) -> DataFrame:
    """lang, classes (shares), common (words, the most frequent first), shares (of these, then of all other words)."""
    most = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "word", "code")
    top = _reference_counts(docs).withColumn("rank", F.row_number().over(most)).where(F.col("rank") <= max(limits.common, 10))
    by_class = [F.coalesce(F.sum(F.when((F.col("kind") == 0) & (F.col("code") == i), F.col("n"))), F.lit(0)).cast("double") for i in range(10)]
    common = F.array_sort(F.collect_list(F.when((F.col("kind") == 1) & (F.col("rank") <= limits.common), F.struct("rank", "word", "n"))))
    total = F.coalesce(F.max(F.when(F.col("kind") == 2, F.col("n"))), F.lit(0)).cast("double")
    own = top.groupBy("lang").agg(F.array(*by_class).alias("classes"), common.alias("common"), total.alias("total"))
    counts = F.transform("common", lambda x: x["n"].cast("double"))
    rest = F.col("total") - F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    all_classes = F.aggregate("classes", F.lit(0.0), lambda a, x: a + x)
    shares = F.transform(F.concat(counts, F.array(rest)), lambda x: x / F.greatest(F.col("total"), F.lit(1.0)))
    out = own.select("lang", F.transform("classes", lambda x: x / F.greatest(all_classes, F.lit(1.0))).alias("classes"), F.transform("common", lambda x: x["word"]).alias("common"), shares.alias("shares"))
    return stored(out, "references")


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of every row of p to the row of q; rows of zeros have distance 0."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.maximum(total, 1)
    m = (p + q) / 2

    def part(a: np.ndarray) -> np.ndarray:
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)

    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(0, (part(p) + part(np.broadcast_to(q, p.shape))) / 2)), 0)


def base_counts(raw: np.ndarray, bounds: np.ndarray, w: Words, window: int = 8) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words per text."""
    n = len(bounds) - 1
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])
    out = np.zeros((n, 5), np.int64)
    out[:, 0] = w.count
    out[:, 1] = sums(~SPACE[raw] & ((raw & 0xC0) != 0x80))
    out[:, 2] = sums(SYMBOL[raw])
    # lines: a text ends with the line feed that follows it
    ends = np.flatnonzero(raw == 0x0A)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    inked = np.concatenate([[0], np.cumsum(~SPACE[raw])])
    some = inked[ends] > inked[starts]
    starts, ends = starts[some], ends[some]
    if len(starts):
        text = np.searchsorted(bounds, starts, side="right") - 1
        key = xxh64(np.concatenate([raw, np.zeros(8, np.uint8)]), starts, ends, 7)
        order = np.lexsort((key, text))
        same = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
        out[:, 3] = np.bincount(text[order][1:][same], minlength=n)
    # windows
    m = len(w.start) - window + 1
    if m > 0:
        h = w.hashes(9)
        key = np.zeros(m, np.uint64)
        for j in range(window):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
        key ^= key >> np.uint64(29)
        text = w.of()
        inside = np.flatnonzero(text[:m] == text[window - 1 :])
        order = inside[np.lexsort((key[inside], text[inside]))]
        same = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
        found = np.zeros(len(order), bool)
        found[1:] |= same
        found[:-1] |= same
        cover = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(cover, order[found], 1)
        np.add.at(cover, order[found] + window, -1)
        out[:, 4] = np.bincount(text[np.cumsum(cover)[:-1] > 0], minlength=n)
    return out


def _batch_references(langs: list[str | None], ref: pa.RecordBatch) -> dict[str | None, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Class shares, common words' hashes and word shares of each language in a batch."""
    out = {}
    for i, lang in enumerate(langs):
        if lang not in out:
            words = ref.column("common")[i].as_py()
            raw = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
            ends = np.cumsum([0, *map(len, words)])
            out[lang] = np.array(ref.column("classes")[i].as_py()), xxh64(raw, ends[:-1], ends[1:], 11), np.array(ref.column("shares")[i].as_py())
    return out


def judge(langs: list[str | None], column: pa.Array, own: dict[str | None, tuple[np.ndarray, np.ndarray, np.ndarray]], limits: Limits) -> tuple[np.ndarray, ...]:
    """Base counts, base_failed, distances and kept for a batch of texts."""
    parts = [(np.zeros((0, 5), np.int64), np.zeros(0, bool), np.zeros((0, 2)), np.zeros(0, bool))]
    for at, to, raw, bounds in pieces(column):
        w = Words(raw, bounds, False)
        counts, classes = base_counts(raw, bounds, w), class_counts(raw, bounds)
        h, text = lower_hashes(w), w.of()
        js = np.zeros((to - at, 2))
        for lang in dict.fromkeys(langs[at:to]):
            class_shares, common, word_shares = own[lang]
            mine = np.array([x == lang for x in langs[at:to]])
            js[mine, 0] = distance(classes[mine], class_shares)
            k = len(common)
            order = np.argsort(common)
            at_word = np.flatnonzero(mine[text])
            place = np.searchsorted(common, h[at_word], sorter=order)
            place = order[np.minimum(place, k - 1)] if k else place
            known = common[place] == h[at_word] if k else np.zeros(len(at_word), bool)
            table = np.bincount(text[at_word[known]] * (k + 1) + place[known], minlength=(to - at) * (k + 1)).reshape(to - at, k + 1)[mine]
            table[:, k] = counts[mine, 0] - table[:, :k].sum(axis=1)
            js[mine, 1] = distance(table, word_shares)
        far = ((js[:, 0] > limits.characters) & (classes.sum(axis=1) >= limits.least_characters)) | ((js[:, 1] > limits.words) & (counts[:, 0] >= limits.least_words))
        failed = (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])
        parts.append((counts, failed, js, ~failed & ~far))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _with_references(docs: DataFrame, limits: Limits) -> DataFrame:
    """row (all columns), l (the language), classes, common, shares. References are broadcast while Spark finds their table small."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("lang").cast("string").alias("l"))
    refs = references(docs, limits)
    return rows.join(refs, rows["l"].eqNullSafe(refs["lang"])).select("row", "l", "classes", "common", "shares")


def assess(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    js_characters, js_words, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("l").to_pylist()
            doc_id, text = b.column("row").flatten()
            counts, failed, js, kept = judge(langs, text, _batch_references(langs, b), limits)
            yield pa.record_batch([doc_id, *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(js[:, 0]), pa.array(js[:, 1]), pa.array(kept)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_characters", "js_words", "kept"])

    d = _with_references(docs.select("doc_id", "lang", "text"), limits).withColumn("row", F.struct("row.doc_id", "row.text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, js_characters double, js_words double, kept boolean")


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """The documents that are kept, with all of their columns, in one scan after the references."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("l").to_pylist()
            kept = judge(langs, b.column("row").flatten()[place], _batch_references(langs, b), limits)[3]
            yield b.select(["row"]).filter(pa.array(kept))

    d = _with_references(docs, limits)
    return d.mapInArrow(run, d.select("row").schema).select("row.*")
