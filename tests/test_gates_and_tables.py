from __future__ import annotations

import hashlib
import json
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gaugeworks import plans
from gaugeworks.functions import plugins, symbolic
from gaugeworks.operators import binning, budget, builders, contrasts, gates, sampling
from gaugeworks.sources import readers, sinks
from gaugeworks.sources.schemas import SCHEMAS


def details(df):
    return sorted((r.gate, r.detail) for r in df.collect())


def test_cover_reports_everything_at_once(spark):
    d = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    found = gates.cover(d(1, 2, 2, 9), d(1, 2, 3), "id")
    assert details(found) == [("duplicate", "2"), ("missing", "3"), ("unknown", "9")]
    with pytest.raises(gates.GateError, match="missing"):
        gates.require_empty(found)
    gates.require_empty(gates.cover(d(1, 2), d(2, 1), "id"))


def test_label_rules(spark):
    good = {"sample_id": "s", "final_status": "CLEAR_ANSWER", "final_answer_correct": "CORRECT", "agreement_type": "FULL_AGREEMENT", "A_B_answer_equivalence": "EQUIVALENT", "final_committed_answer": "5", "adjudication_reason": ""}
    for who in "AB":
        good |= {f"{who}_status": "CLEAR_ANSWER", f"{who}_answer_correct": "CORRECT", f"{who}_committed_answer": "5", f"{who}_evidence_span": "5", f"{who}_notes": "", f"{who}_reference_issue": "NO"}
    good |= {f"{r}_fidelity": "FAITHFUL" for r in ("strict", "fallback", "mv")}
    broken = [good, good | {"sample_id": "t", "A_status": "NO_ANSWER"}, good | {"sample_id": "u", "mv_fidelity": "NOT_APPLICABLE", "final_committed_answer": " "}]
    d = spark.createDataFrame(broken, ", ".join(f"{k} string" for k in good))
    found = {x[1] for x in details(gates.implications(d, "sample_id", gates.label_rules()))}
    assert found == {"t: A_no answer is incorrect", "t: full agreement fits the labels", "t: disagreement has a reason", "u: final clear answer is stated", "u: mv clear answer has a fidelity"}


def test_chronology(spark):
    d = spark.createDataFrame([("A", 1, "2026-01-02T00:00:00Z"), ("B", 1, "2026-01-03T00:00:00+00:00"), ("A", 2, "2026-01-02T12:00:00Z"), ("B", 2, "2026-01-04T00:00:00")], "role string, stage int, utc string")
    assert details(gates.chronology(d)) == [("no time zone", "B/2"), ("too early", "A/2")]


def test_other_gates(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "z")], "k int, v string")
    assert {g for g, _ in details(gates.equal_tables(a, b))} == {"only left", "only right"}
    assert details(gates.same_values(a.union(b), ["k"], ["v"])) == [("differs", "group,2")]
    assert details(gates.all_or_none(spark.createDataFrame([(1,), (None,)], "x int"), "x")) == [("partly present", "x")]
    assert details(gates.predicate(a, "domain", F.col("v") == "x", F.col("k"))) == [("domain", "2")]


def test_jsonl_scans(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "ground_truth": "a"}\n\nnot json\n{"id": 2, "ground_truth": "b"}\n{"id": 1, "ground_truth": "c"}\n')
    schema = "id bigint, ground_truth string"
    assert readers.tolerant_jsonl(spark, [str(p), str(tmp_path / "missing.jsonl")], schema).count() == 3
    assert readers.tolerant_jsonl(spark, [str(tmp_path / "missing.jsonl")], schema).count() == 0
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        readers.strict_jsonl(spark, str(p), schema).collect()
    p.write_text("\n".join(x for x in p.read_text().split("\n") if x != "not json"))
    assert {(r.id, r.ground_truth) for r in readers.keyed_jsonl(spark, str(p), schema).collect()} == {(1, "c"), (2, "b")}


def test_cells_and_explode(spark, tmp_path):
    folder = tmp_path / "83" / "hash" / "boxed"
    folder.mkdir(parents=True)
    row = {"id": 5, "n": 2, "responses": ["a", "b"], "finish_reasons": ["stop", "length"], "output_token_counts": [3, 4], "input_tokens": 7}
    (folder / "responses.jsonl").write_text(json.dumps(row) + "\n")
    (folder / "DONE.json").write_text("{}")
    got = readers.exploded(readers.cell_responses(spark, str(tmp_path))).orderBy("sample").collect()
    assert [(r.seed, r.trained, r.request, r.id, r["sample"], r.response, r.finish_reason, r.output_tokens) for r in got] == [("83", "hash", "boxed", 5, 0, "a", "stop", 3), ("83", "hash", "boxed", 5, 1, "b", "length", 4)]
    assert readers.markers(spark, str(tmp_path), "DONE.json").count() == 1


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    sinks.create_only(d, str(tmp_path / "t"))
    with pytest.raises(AnalysisException):
        sinks.create_only(d, str(tmp_path / "t"))
    for _ in range(2):
        sinks.append_new(d.union(spark.createDataFrame([(3, "c")], "id long, v string")), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    sinks.published(d, str(tmp_path / "p"))
    sinks.published(d.limit(1), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.txt").write_text("hello")
    stated = spark.createDataFrame(sinks.receipts(spark, str(tmp_path / "f")).collect(), SCHEMAS["receipts"])
    sinks.verify_receipts(spark, stated, str(tmp_path / "f"))
    (tmp_path / "f" / "x.txt").write_text("changed")
    with pytest.raises(gates.GateError, match="receipt"):
        sinks.verify_receipts(spark, stated, str(tmp_path / "f"))
    assert sinks.markdown(spark.createDataFrame([("a", 0.5)], "k string, v double")).splitlines()[2] == "| a | +0.5000 |"
    assert sinks.latex(spark.createDataFrame([("a_b", None)], "k string, v double")) == "a\\_b & XX.X \\\\\n"


def test_arithmetic_items(spark):
    d = readers.arithmetic_items(spark)
    assert d.count() == 532 and d.select("meta.expression").distinct().count() == 532
    assert all(readers.exact_value(r.e) == int(r.ground_truth) for r in d.select(F.col("meta.expression").alias("e"), "ground_truth").limit(50).collect())
    rows = d.collect()
    plain = [(*r[:3], tuple(r[3])) for r in rows]
    order = {"dev": 0, "test": 1}
    plain.sort(key=lambda r: (order[r[3][0]], r[0]))
    assert hashlib.sha256(repr(plain).encode()).hexdigest() == "e64c3a09e157917c5384c8bb3936c52f385be72eed1c4fbb318bf206e2358a5a"
    with pytest.raises(ValueError):
        readers.exact_value("__import__('os')")


def test_published_survives_a_broken_swap(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.published(spark.range(3), path)
    sinks.published(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and sorted(x.name for x in tmp_path.iterdir()) == ["t"]
    (tmp_path / "t").rename(tmp_path / "t.old")  # a run that ended between the renames
    sinks.recovered(spark, path)
    assert spark.read.parquet(path).count() == 5
    (tmp_path / "t").rename(tmp_path / "t.old")
    sinks.published(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7 and sorted(x.name for x in tmp_path.iterdir()) == ["t"]


def test_documents_and_manifests(spark, tmp_path):
    path = tmp_path / "m.json"
    for n in (1, 2):
        sinks.durable_json({"b": n, "a": [None, "\u00e9"]}, spark, str(path))
        assert json.loads(path.read_text()) == {"a": [None, "\u00e9"], "b": n} and path.read_text().index('"a"') < path.read_text().index('"b"')
    frozen = str(tmp_path / "frozen.json")
    assert sinks.frozen_manifest(spark, frozen, {"seed": 1}) == {"seed": 1} == sinks.frozen_manifest(spark, frozen, {"seed": 1})
    assert (tmp_path / "frozen.json").stat().st_mode & 0o777 == 0o444
    with pytest.raises(ValueError, match="seed"):
        sinks.frozen_manifest(spark, frozen, {"seed": 2})


def test_csv_and_jsonl(spark, tmp_path):
    d = spark.createDataFrame([(1, "a,b", None), (2, 'q"', "x")], "i int, t string, u string").coalesce(1)
    for mark in (False, True):
        sinks.csv(d, str(tmp_path / f"c{mark}"), ["t", "i"], mark)
        text = next((tmp_path / f"c{mark}").glob("part-*")).read_text(encoding="utf-8")
        assert text.startswith("\ufeff") == mark and text.lstrip("\ufeff").splitlines()[0] == "t,i"
    sinks.jsonl(d, str(tmp_path / "j"))
    lines = next((tmp_path / "j").glob("part-*")).read_text().splitlines()
    assert [json.loads(x) for x in lines] == [{"i": 1, "t": "a,b", "u": None}, {"i": 2, "t": 'q"', "u": "x"}]


@pytest.mark.parametrize("width", [3, 1000])
def test_positions_in_order(spark, width):
    keys = [5, -7, 100, 2, 3, 4, 99, 1 << 40]
    got = binning.position_in_order(spark.createDataFrame([(k,) for k in keys], "id long"), "id", width, "position").collect()
    assert {r.id: r.position for r in got} == {k: i for i, k in enumerate(sorted(keys))}


def test_bins_score_each_response_once(spark, data):
    """The summary's plan reads what was written, not the responses again."""
    plan = plans.QUERIES["bin_summary"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and plan.count("Scan ExistingRDD") <= 3
    verdicts = plans.QUERIES["per_item_counts"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("l_partkey#[0-9]+,", verdicts)) <= 2 and len(re.findall("regexp|RLIKE", verdicts)) < 30


def test_prompt_rewrite(spark):
    d = spark.createDataFrame([([("user", "q after ####")],), ([("user", "q")],), ([("user", "a ####"), ("user", "b ####")],)], "p array<struct<role:string,content:string>>")
    got = [r[0] for r in d.select(builders.rewrite_prompt(F.col("p"), "####", "box")).collect()]
    assert got[0][0].content == "q after box" and got[1] is None and got[2] is None


def test_ema_and_consistency(spark):
    d = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 0.0), ("b", 1, 4.0)], "s string, t int, v double")
    got = {r.s: r.second_moment for r in sampling.ema(d, "s", "t", "v", 1.0, 0.5, 1.0).collect()}
    assert got == pytest.approx({"a": 1.25, "b": 2.5})
    assert sampling.draw_consistency(d, "s", ["t"], ["v"]).count() == 1


def test_missing_cells_and_decomposition(spark):
    d = spark.createDataFrame([(1, "x")], "a int, b string")
    assert contrasts.missing_cells(d, {"a": [1, 2], "b": ["x", "y"]}).count() == 3
    parts = contrasts.decompose(F.lit(0.1), F.lit(0.7), F.lit(0.7), F.lit(0.7))
    r = spark.range(1).select(*[c.alias(n) for n, c in parts.items()]).first()
    assert r.net_gap_reduction == pytest.approx(0.6) and r.initial_gap_share == pytest.approx(1.0)


@pytest.mark.parametrize("a,b,want", [("\\frac{1}{2}", "0.5", True), ("$1,000$", "1000", True), ("50\\%", "0.5", True), ("(1, 2)", "(1,2)", True), ("(1,2)", "(2,1)", False), ("\\{1,2\\}", "\\{2,1\\}", True), ("\\sqrt{9}", "3", True), ("x = 5", "5", True), ("\\text{Yes}", "yes", True), ("3\\frac12", "3.5", True), ("", "1", None), ("x+1", "x + 1", True), ("7", "8", False), ("x+1", "x+2", None), ("7", "the answer is 7", None)])
def test_symbolic(a, b, want):
    assert symbolic.same(a, b) is want


def test_symbolic_readers(spark):
    rows = [("so \\boxed{\\frac{1}{2}}", "0.5"), ("no box 0.5", "0.5"), ("#### \\frac{1}{2}", "0.5"), ("last line\n$3$", "3"), ("#### the answer is 7", "7"), ("some\nthe answer is 7", "7"), ("open \\boxed{7", "7"), ("first 7\nthen x", "7"), ("\\boxed{seven} 7", "7")]
    d = spark.createDataFrame(rows, "r string, g string")
    r, g = F.col("r"), F.col("g")
    got = d.select(symbolic.math_strict(r, g), symbolic.math_lenient(r, g), symbolic.math_hashes_strict(r, g)).collect()
    want = [(True, True, False), (False, True, False), (False, False, True), (False, True, False), (False, True, True), (False, True, False), (True, True, False), (False, True, False), (True, True, False)]
    assert [tuple(x) for x in got] == want


def test_receipts_cover_all_orders(spark, data):
    """Against hashes put together row by row, and a change in any one order changes its part's receipt."""
    import hashlib
    from itertools import groupby

    from gaugeworks import plans

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def receipt(keys):
        level = [(k, f"{sha(str(k))}x{len(list(g))}") for k, g in groupby(sorted(keys))]
        for _ in range(2):
            level = [(to, sha(",".join(f"{k}:{h}" for k, h in g))) for to, g in groupby(level, lambda x: x[0] >> 12)]
        return sha(",".join(f"{k}:{h}" for k, h in level)), len(keys)

    orders = spark.read.parquet(f"{data}/orders.parquet").select("o_orderpriority", "o_orderkey")
    keys = {}
    for p, k in orders.collect():
        keys.setdefault(p, []).append(k)
    got = {r.name: (r.sha256, r.rows) for r in plans.QUERIES["receipt_hashes"](spark, data).collect()}
    assert got == {p: receipt(x) for p, x in keys.items()}
    odd = [("a", x) for x in (-5000, -1, 0, 0, 7, 1 << 25, (1 << 25) + 1)]
    other = [[*odd[:i], ("a", odd[i][1] + 50), *odd[i + 1 :]] for i in range(len(odd))] + [odd[:2] + odd[3:]]
    found = [builders.row_receipts(spark.createDataFrame(x, "p string, k long"), "p", "k").first() for x in [odd, *other]]
    assert (found[0].sha256, found[0].rows) == receipt([k for _, k in odd])
    assert all(r.sha256 != found[0].sha256 for r in found[1:])


def test_exact_rows(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("\ufeff" + "".join(json.dumps({"id": i, "t": "é"}) + "\n\n" for i in range(5)), encoding="utf-8")
    assert [r.id for r in readers.exact_rows(spark, str(path), "id bigint, t string", 5).collect()] == list(range(5))
    with pytest.raises(ValueError, match="5 rows"):
        readers.exact_rows(spark, str(path), "id bigint, t string", 6)
    for text in ('{"id": 1}\n{"id": 0}\n', '{"id": 0}\n{"id": "x"}\n', '{"id": 0}\n{"id": 1.0}\n'):
        path.write_text(text)
        with pytest.raises(ValueError, match="another id"):
            readers.exact_rows(spark, str(path), "id string", 2)


def test_gates_of_samplers_and_ledgers(spark):
    d = spark.createDataFrame([([1.0, -2.0], 0.5)], "advantages array<double>, importance_weight double")
    once = sampling.apply_correction(d)
    assert once.first().advantages == [0.5, -1.0]
    with pytest.raises(ValueError, match="already"):
        sampling.apply_correction(once)
    none = spark.createDataFrame([(1, 0.0)], "i int, w double")
    assert details(sampling.probability_violations(none, "i", F.col("w"))) == [("no mass", "0.0")]
    assert details(budget.domain_violations(spark.createDataFrame([(1, True, 1.5)], "i int, c boolean, s double"), "i", ["c"], ["s"]).select(F.col("field").alias("gate"), F.col("i").cast("string").alias("detail"))) == [("c", "1")]
    rows = [("completions", 5.0, 5.0, 0.0, True), ("generated_tokens", 1.0, 2.0, 1.0, False)]
    table = lambda x: spark.createDataFrame(x, "counter string, left double, right double, difference double, hard boolean")
    budget.require_equal(table(rows))
    for bad in (("reward_calls", 5.0, 6.0, 1.0, True), ("reward_calls", 5.0, None, None, True)):
        with pytest.raises(ValueError, match="reward_calls"):
            budget.require_equal(table([*rows, bad]))


def test_signers(spark):
    locks = lambda *x: spark.createDataFrame(list(x), "who string, stage int, signer string")
    good = locks(("A", 1, "Ann "), ("A", 2, "ann"), ("B", 1, "Bo"), ("B", 2, "Bo"))
    assert details(gates.signer_violations(good, "Cy")) == []
    assert details(gates.signer_violations(good, " BO ")) == [("adjudicates", "bo")]
    assert details(gates.signer_violations(good, None)) == [("no adjudicator", "")]
    assert details(gates.signer_violations(locks(("A", 1, "x"), ("A", 2, "y"), ("B", 1, "X")), "z")) == [("changed", "A"), ("not distinct", "x")]


def test_columns_structs_and_plug_ins(spark, tmp_path):
    d = spark.sql("SELECT named_struct('a', 1, 'b', 2) AS x, named_struct('b', 3, 'c', 4) AS y")
    assert d.select(builders.merged(d, "x", "y").alias("m")).first().m.asDict() == {"a": 1, "b": 3, "c": 4}
    assert gates.require_columns(d, ["x"]) is d
    with pytest.raises(gates.GateError, match="missing columns: q, z"):
        gates.require_columns(d, ["z", "x", "q"])
    path = tmp_path / "scorer.py"
    path.write_text("def score(a):\n    return a + 1\n")
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    assert plugins.load_module(str(path), ["score"], digest).score(1) == 2
    with pytest.raises(AttributeError, match="other"):
        plugins.load_module(str(path), ["score", "other"])
    with pytest.raises(ValueError, match="frozen"):
        plugins.load_module(str(path), ["score"], "0" * 64)
    assert plugins.plug_in("collections:Counter", ["most_common"], "aab").most_common(1) == [("a", 2)]
    with pytest.raises(TypeError, match="draw"):
        plugins.plug_in("collections:Counter", ["draw"])
