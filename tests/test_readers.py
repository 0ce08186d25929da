from __future__ import annotations

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.functions import readers as R

# response, first hash, boxed, flat box, last number
CASES = [
    ("#### 72", "72", None, None, "72"),
    ("#### 1,234", "1234", None, None, "1234"),
    ("##### 12", "12", None, None, "12"),
    ("####\n12", "12", None, None, "12"),
    ("#### $2400", None, None, None, "2400"),
    ("#### **`-24`**", None, None, None, "-24"),
    ("#### 1 and #### 2", "1", None, None, "2"),
    (r"\boxed{12}", None, "12", "12", "12"),
    (r"\boxed{\frac{1}{2}}", None, r"\frac{1}{2}", None, "2"),
    (r"\boxed{ 72 }", None, " 72 ", "72", "72"),
    (r"\boxed {5}", None, None, None, "5"),
    (r"\boxed{754", None, None, None, "754"),
    (r"\boxed{1} \boxed{2}", None, "1", "2", "2"),
    (r"\boxed{}", None, "", "", None),
    ("", None, None, None, None),
]


def test_conformance_matrix(spark):
    d = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    t = F.col("t")
    got = d.select("i", R.first_hash(t), R.boxed(t), R.flat_box(t), R.last_number(t)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [c[1:] for c in CASES]


def test_payload_readers(spark):
    texts = [r"\boxed {5} x \boxed{ }", "a #### 3 b\n#### \n", "####\n7", "nothing", r"\boxed{a{b}c} \boxed{z"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    got = d.select(R.boxed_payload(t), R.boxed_payload(t, "last"), R.hash_line(t), R.hash_line(t, "last"), R.hash_any(t), R.flexible_number(t)).orderBy("i").collect()
    assert [tuple(r) for r in got] == [
        ("5", None, None, None, None, "5"),
        (None, None, "3 b", None, "3 b", "3"),
        (None, None, None, None, "7", "7"),
        (None, None, None, None, None, None),
        ("a{b}c", None, None, None, None, None),
    ]


def equal(a: str | None, b: str | None) -> bool:
    if a is None or b is None:
        return False
    try:
        return abs(float(a) - float(b)) < 1e-3
    except ValueError:
        return a.strip() == b.strip()


def test_numeric_equal(spark):
    pairs = [("1", "1.0004"), ("1", "1.002"), ("12d", "12"), (" x ", "x"), (None, "1"), ("1_000", "1000"), ("nan", "nan"), ("1e3", "1000"), ("5.", "5"), ("", ""), ("inf", "Infinity"), ("-inf", "5"), ("NaN", "5"), ("\u0663.5", "3.5"), ("\u0667", "7.0"), ("infinite", "infinite"), ("\u00b2", "2"), ("\u2003 8", "8\u00a0")]
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select(R.numeric_equal(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [equal(a, b) for a, b in pairs]


def test_verdicts_and_fields_once(spark):
    """The structs that extract once say what the single readers say."""
    pairs = [(c[0], g) for c in CASES for g in ("#### 72", "12", "x", "#### 1,234")] + [(None, "1"), ("#### nan", "nan")]
    r, g = F.col("r"), F.col("g")
    d = spark.createDataFrame(pairs, "r string, g string")
    single = [R.strict(r, g), R.lenient(r, g), R.numeric_equal(R.last_hash(r), R.reference(g)), R.numeric_equal(R.last_number(r), R.reference(g))]
    for x in d.select(R.verdicts(r, g).alias("v"), R.score_struct(r, g).alias("s"), *[c.alias(f"c{i}") for i, c in enumerate(single)]).collect():
        assert (x.v.strict, x.v.lenient) == (x.c0, x.c1) == (x.s.strict_first_hash, x.s.frozen_lenient)
        assert (x.s.strict_last_hash, x.s.last_number) == (x.c2, x.c3)


PIECES = st.lists(st.sampled_from(["####", "#", " ", "\n", "-", "1", "23", ".", ",", "$", "\\boxed{", "{", "}", "x", "boxed", "@@@"]), max_size=12).map("".join)


@settings(max_examples=8, deadline=None)
@given(st.lists(PIECES, min_size=20, max_size=40))
def test_readers_equal_a_plain_model(spark, texts):
    def first(t):
        m = re.search(r"####\s*(-?\d+\.?\d*)", t.replace(",", ""))
        return m and m[1]

    def number(t):
        return (re.findall(r"-?\d+\.?\d*", t.replace(",", "")) or [None])[-1]

    def box(t):
        at, depth = t.find("\\boxed{"), 1
        for i in range(at + 7, len(t) if at >= 0 else 0):
            depth += {"{": 1, "}": -1}.get(t[i], 0)
            if not depth:
                return t[at + 7 : i]
        return None

    t = F.col("t")
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(R.first_hash(t), R.last_number(t), R.boxed(t)).collect()
    assert [tuple(r) for r in got] == [(first(x), number(x), box(x)) for x in texts]


def test_null_is_never_credited(spark):
    d = spark.createDataFrame([(None, "#### 1"), ("#### 1", "#### 1")], "r string, g string")
    got = d.select(*[f(F.col("r"), F.col("g")) for s in R.SCORERS.values() for f in s.values()], R.lenient_reward(F.col("r"), F.col("g"))).collect()
    assert not any(got[0])
    assert got[1][0] and got[1][-1] == 1.0


def test_boxes_before_long_tails(spark):
    """A tail without braces is read once: a search from each of its characters took the square of its length. Measured by
    time, for a text that took minutes."""
    tail = " and so on" * 40_000
    texts = [r"\boxed{5}" + tail, r"a \boxed { {6} } \boxed{7}" + tail, r"\boxed{8" + tail, tail, None]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    start = time.monotonic()
    got = d.select("i", R.boxed_payload(t), R.boxed_payload(t, "last")).orderBy("i").collect()
    assert time.monotonic() - start < 30
    assert [tuple(r)[1:] for r in got] == [("5", "5"), ("{6}", "7"), (None, None), (None, None), (None, None)]


def test_closed_part_with_escapes(spark):
    """Escaped braces are text at the end too, however long a text is."""
    long = "x" * 100_000
    cases = [(r"5} 6", "5"), (r"{5} 7\}", None), (r"5\}", None), (r"5\} 6} 7", r"5\} 6"), (r"5\\} 6", r"5\\"), ("5\\", None), ("{5}\\", None), ("", None), (long + "}" + long, long), (long + r"\}" + long, None), (None, None)]
    d = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = d.select("i", R.closed_part(F.col("t"), True)).orderBy("i").collect()
    assert [r[1] for r in got] == [c[1] for c in cases]


def test_first_box_before_long_tails(spark):
    """The same for the first box."""
    tail = " and so on" * 40_000
    texts = [r"\boxed{5}" + tail, r"a \boxed{ {6}} \boxed{7}" + tail, r"\boxed{8" + tail, tail]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    start = time.monotonic()
    got = d.select("i", R.boxed(F.col("t"))).orderBy("i").collect()
    assert time.monotonic() - start < 30
    assert [r[1] for r in got] == ["5", " {6}", None, None]


def test_verdicts_with_box(spark):
    """The struct with a box says what boxed_strict says; long tails don't hold it up."""
    tail = " and so on" * 40_000
    pairs = [(c[0] + t, g) for c in CASES for g in ("#### 72", "12", "x") for t in ("", tail)] + [(None, "1"), (r"\boxed{nan}", "nan")]
    d = spark.createDataFrame(pairs, "r string, g string")
    r, g = F.col("r"), F.col("g")
    start = time.monotonic()
    got = d.select(R.verdicts(r, g, box=True).alias("v"), R.verdicts(r, g).alias("w"), R.boxed_strict(r, g).alias("b")).collect()
    assert time.monotonic() - start < 60
    assert [tuple(x.v) for x in got] == [(x.w.strict, x.w.lenient, x.b) for x in got]
    assert sum(x.b for x in got) == 2 * sum(equal((re.findall(r"-?\d+\.?\d*", c[2] or "") or [None])[-1], g) for c in CASES for g in ("72", "12", "x"))
