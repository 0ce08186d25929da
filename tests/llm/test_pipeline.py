from __future__ import annotations

import collections
import zlib

import numpy as np
from pyspark.sql import functions as F
from test_decontamination_and_quality import WORD, counts, js, leaks
from test_words_and_simhash import classes, jaccard
from tokenizers import Tokenizer

import corpus_pipeline as P
from gaugeworks.llm import quality, queries
from gaugeworks.llm.common import stored, table


def good_documents(rows):
    """doc_ids that pass the base rules and the distances of plain histograms."""
    kept = []
    for lang in {r.lang for r in rows}:
        own = [r for r in rows if r.lang == lang]
        words = {id(r): [w.encode().lower() for w in WORD.findall(r.text or "")] for r in own}
        classes = {id(r): quality.class_counts(np.frombuffer((r.text or "").encode() + b"\n", np.uint8), np.array([0, len((r.text or "").encode()) + 1]))[0] for r in own}
        count = collections.Counter(w for x in words.values() for w in x)
        common = [w for w, _ in sorted(count.items(), key=lambda kv: (-kv[1], kv[0]))[:32]]
        total = max(1, sum(count.values()))
        ref_words = [count[w] / total for w in common] + [1 - sum(count[w] for w in common) / total]
        ref_classes = sum(classes.values()) / max(1, sum(c.sum() for c in classes.values()))
        for r in own:
            n, _, _, _, repeats = counts(r.text)
            c = collections.Counter(words[id(r)])
            hist = [c[w] for w in common]
            far = js(classes[id(r)], ref_classes) > 0.32 and classes[id(r)].sum() >= 200 or n >= 40 and js([*hist, n - sum(hist)], ref_words) > 0.48
            if n >= 20 and 100 * repeats <= 30 * n and not far:
                kept.append(r.doc_id)
    return sorted(kept)


def test_stages_one_by_one_against_brute_force(spark, data):
    docs = table(spark, data, "documents")
    outputs = {}
    for name, stage in P.STAGES:
        before = docs
        docs = outputs[name] = stored(stage(spark, docs, data), name)
        rows = {r.doc_id: r for r in before.collect()}
        if name != "token_store":
            assert docs.columns == before.columns
        got = docs.collect()
        if name == "quality_rules":
            assert sorted(r.doc_id for r in got) == good_documents(list(rows.values()))
        elif name == "near_duplicates":
            ids = sorted(rows)
            found = classes(len(ids), lambda i, j: rows[ids[i]].text == rows[ids[j]].text or jaccard(rows[ids[i]].text, rows[ids[j]].text))
            assert {r.doc_id for r in got} == {ids[i] for i in set(found)}
        elif name == "benchmark_passages":
            items = [(r.item_id, r.text) for r in table(spark, data, "benchmark").collect()]
            assert {r.doc_id for r in got} == set(rows) - {d for d, _ in leaks([(i, r.text) for i, r in rows.items()], items)}
        elif name == "mixture":
            assert all(tuple(r) == tuple(rows[r.doc_id]) for r in got)
            assert max(np.unique([r.doc_id for r in got], return_counts=True)[1]) <= 3
            # sources' words come near their targets, which are worked out here by sharing again and again
            sizes = collections.Counter()
            for r in rows.values():
                sizes[r.source] += len(WORD.findall(r.text or ""))
            taken = collections.Counter()
            for r in got:
                taken[r.source] += len(WORD.findall(r.text or ""))
            names = sorted(sizes, key=lambda x: (x is None, x))
            weight, capped = {x: i % 3 + 1 for i, x in enumerate(names)}, set()
            while True:
                level = (sum(sizes.values()) - 3 * sum(sizes[x] for x in capped)) / max(1, sum(w for x, w in weight.items() if x not in capped))
                over = {x for x in names if x not in capped and weight[x] * level > 3 * sizes[x]}
                if not over:
                    break
                capped |= over
            longest = max(len(WORD.findall(r.text or "")) for r in rows.values())
            for x in names:
                target = 3 * sizes[x] if x in capped else weight[x] * level
                assert abs(taken[x] - target) <= longest + 256, x
        else:
            t = Tokenizer.from_file(queries.tokenizer_path())
            start, want = 0, []
            for r in sorted(before.collect(), key=lambda r: r.doc_id):
                ids = t.encode(r.text, add_special_tokens=False).ids + [2]
                want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
                start += len(ids)
            assert sorted(tuple(r)[:4] for r in got) == sorted(want)
    assert sorted(map(tuple, P.run(spark, data).collect())) == sorted(map(tuple, outputs["token_store"].collect()))


def test_stages_keep_clashing_columns(spark, documents, data):
    """Columns whose names operators use come through as they were."""
    text = " ".join(f"word{i % 40} of no. {i}," for i in range(200))
    docs = documents([text, text, text + " more"], ids=[1, 2, 3])
    names = ("row", "l", "digest", "node", "root", "_row", "_copy", "copies", "part_to", "_order", "size_", "common", "shard")
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, data)
        rows = out.collect()
        assert out.columns == docs.columns and rows
        assert all(r[name] == f"{name}{r.doc_id}" for r in rows for name in names)


def test_stages_take_empty_and_odd_tables(spark, documents, data):
    odd = documents([None, "", "a b c", "a b c"], ids=[None, 1, 2, 2], sources=[None, "a", "a", "a"], langs=[None, "en", "en", "en"])
    for docs in (documents([]), odd):
        for name, stage in P.STAGES:
            out = stage(spark, docs, data)
            out.collect()
            assert name == "token_store" or out.columns == docs.columns
