from __future__ import annotations

import math
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gaugeworks import plans
from gaugeworks.functions import hashing, readers
from gaugeworks.operators import binning, calibration, contrasts, passk, sampling
from gaugeworks.sources.fixtures import TWELVE, scored


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_summary_golden(spark):
    d = scored(spark, "/root/testdata/sf0.01", TWELVE)
    verdicts = readers.verdicts(F.col("response"), F.col("ground_truth"))
    r = passk.summary(passk.per_item(d, verdicts["lenient"], verdicts["strict"])).first()
    assert (r.n_items, r.n_responses, r.correct, r.correct_strict, r.min_n, r.max_n, r.zero_correct) == (14743, 60000, 35123, 15038, 1, 13, 1194)
    assert r.mean_solve_rate == pytest.approx(0.584367088, abs=1e-9)
    assert r.mean_solve_rate_strict == pytest.approx(0.250127192, abs=1e-9)


@pytest.mark.parametrize("n,c,k,want", [(8, 3, 1, 0.375), (8, 3, 4, 0.928571428571), (4, 1, 2, 0.5), (13, 5, 8, 0.999222999223), (4, 0, 2, 0.0), (4, 3, 2, 1.0)])
def test_pass_at_k(spark, n, c, k, want):
    assert one(spark, passk.pass_at_k(F.lit(n), F.lit(c), F.lit(k))) == pytest.approx(want, abs=1e-11)


def test_pass_at_more_than_n_is_nan(spark):
    assert math.isnan(one(spark, passk.pass_at_k(F.lit(2), F.lit(1), F.lit(3))))


@pytest.mark.parametrize("args,want", [((0, 20, 500, 0.05), (0, 0.164)), ((2, 4, 12, 0.05), (0.166667, 0.833333)), ((15, 30, 374, 0.05), (0.320856, 0.679144)), ((30, 30, 993, 0.05), (0.886203, 1)), ((0, 20, 500, 0.05 / 408), (0, 0.376)), ((15, 30, 374, 0.05 / 408), (0.192513, 0.807487)), ((30, 30, 993, 0.05 / 408), (0.728097, 1)), ((2, 4, 4, 0.05), (0.5, 0.5))])
def test_hypergeometric(args, want):
    assert calibration.hypergeometric_interval(*args) == pytest.approx(want, abs=1e-6)


def test_hypergeometric_covers():
    from math import comb

    for k in range(13):
        inside = sum(comb(k, x) * comb(12 - k, 4 - x) for x in range(5) if (ci := calibration.hypergeometric_interval(x, 4, 12, 0.1)) and ci[0] - 1e-12 <= k / 12 <= ci[1] + 1e-12)
        assert inside / comb(12, 4) >= 0.9 - 1e-12


@pytest.mark.parametrize("gained,lost,p", [(5, 1, 0.21875), (3, 3, 1.0), (10, 2, 0.03857421875), (0, 0, 1.0)])
def test_mcnemar(spark, gained, lost, p):
    g, x = F.lit(gained).cast("long"), F.lit(lost).cast("long")
    assert one(spark, contrasts.mcnemar_p(g, x)) == pytest.approx(p, abs=1e-12)
    assert one(spark, contrasts.mcnemar_exact(g, x)) == pytest.approx(p, abs=1e-15)


def whole(gained, lost):
    """The test in whole numbers, each term from the last."""
    n, term, total = gained + lost, 1, 1
    for i in range(1, min(gained, lost) + 1):
        term = term * (n - i + 1) // i
        total += term
    return min(1.0, float(Fraction(2 * total, 2**n)))


def test_mcnemar_of_large_counts(spark):
    """At the counts of a 0.1 GB table each term can't be made anew: that took minutes a row."""
    pairs = [(60_000, 60_800), (60_000, 60_001), (1_300, 1_200), (20, 1_500), (0, 800), (7, 0)]
    d = spark.createDataFrame(pairs, "g long, l long")
    start = time.monotonic()
    got = [r[0] for r in d.select(contrasts.mcnemar_exact(F.col("g"), F.col("l"))).collect()]
    assert time.monotonic() - start < 60
    assert got == pytest.approx([whole(*p) for p in pairs], rel=1e-10, abs=0)


def test_mcnemar_columns_do_not_underflow(spark):
    """2^-n is zero from n = 1075 on."""
    pairs = [(619, 591), (689, 575), (60_000, 60_800), (20, 1_500), (1_000, 1_000), (537, 538), (0, 800), (7, 0), (0, 0)]
    d = spark.createDataFrame(pairs, "g long, l long")
    got = [r[0] for r in d.select(contrasts.mcnemar_p(F.col("g"), F.col("l"))).collect()]
    assert got == pytest.approx([whole(*p) for p in pairs], rel=1e-10, abs=0)


def test_blake2b_order_keys(spark):
    d = spark.createDataFrame([(f"difficulty-tie:{i}",) for i in range(4)] + [(f"audit:20260717:{i}",) for i in range(3)], "t string")
    got = [int(r[0], 16) for r in d.select(hashing.blake2b64(F.col("t"))).collect()]
    assert got == [12005603309864819172, 17949764384634142363, 9685178928741042419, 5534772898083271291, 14468435731070183672, 13747609110889982318, 15518113189872256034]


def test_seed_rule(spark):
    assert [one(spark, hashing.shard_seed(20260716, F.lit(i))) for i in (0, 7472)] == [1416056350, 1416063822]


def test_proposals(spark):
    s = spark.createDataFrame([(0, 2302, 24334, 0.25), (1, 3282, 34693, 1.0), (2, 1912, 40973, 4.0)], "s int, t long, o long, m double")
    s = sampling.normalized(sampling.normalized(s, F.col("t"), "target"), F.col("o"), "oracle")
    s = sampling.epsilon_mixture(s, F.col("oracle"), F.col("target"), 1e-6, "mixed")
    for beta in (0, 1, 2):
        s = sampling.powered_proposal(s, F.col("target"), F.col("m"), float(beta), f"p{beta}")
    r = s.orderBy("s").toPandas()
    assert r.target.tolist() == pytest.approx([0.307097118, 0.437833511, 0.25506937], abs=1e-9)
    assert r.mixed.tolist() == pytest.approx([0.243340063757, 0.346930090904, 0.409729845339], abs=1e-12)
    assert r.p1.tolist() == pytest.approx([0.139397, 0.397481, 0.463122], abs=1e-6)
    assert r.p2.tolist() == pytest.approx([0.050020, 0.285255, 0.664726], abs=1e-6)
    with pytest.raises(ValueError):
        sampling.epsilon_mixture(s, F.col("oracle"), F.col("target"), 0.0, "x")


def test_bins_are_not_ntile(spark):
    d = spark.createDataFrame([(i, i) for i in range(6)], "row_id long, solve_count long")
    got = [r["count"] for r in binning.balanced_bins(d, 4).groupBy("difficulty_bin").count().orderBy("difficulty_bin").collect()]
    assert got == [2, 1, 2, 1]


def test_blake2b_bins_follow_a_plain_model(spark):
    import hashlib

    rows = [(i, i % 3) for i in range(101)]
    got = {r.row_id: r.difficulty_bin for r in binning.balanced_bins(spark.createDataFrame(rows, "row_id long, solve_count long"), 4, hashing.blake2b64).collect()}
    order = sorted(rows, key=lambda r: (r[1], hashlib.blake2b(f"difficulty-tie:{r[0]}".encode(), digest_size=8).digest()))
    assert got == {r[0]: min(k * 4 // 101, 3) for k, r in enumerate(order)}


def test_draws_do_not_depend_on_partitions(spark):
    s = spark.createDataFrame([("a", 0.2), ("b", 0.8)], "s string, p double")
    a = sampling.draw_categorical(s, "s", "p", 9000, 3).toPandas().set_index("draw_number").s
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    b = sampling.draw_categorical(s, "s", "p", 9000, 3).toPandas().set_index("draw_number").s
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert a.sort_index().tolist() == b.sort_index().tolist()
    assert (a == "b").mean() == pytest.approx(0.8, abs=0.02)


def test_interval_arithmetic(spark):
    box = calibration.interval(F.lit(0.2), F.lit(0.4), F.lit(0.1), F.lit(0.5))
    got = one(spark, calibration.linear([(1.0, calibration.exact(F.lit(1.0))), (-1.0, box)]))
    assert (got.lower_estimate, got.upper_estimate, got.ci_low, got.ci_high) == pytest.approx((0.6, 0.8, 0.5, 0.9))
    assert got.estimate is None
    none = one(spark, calibration.ratio(box, calibration.exact(F.lit(0.0))))
    assert none.lower_estimate is None and none.ci_high is None


def test_weighted_accuracy_of_the_unit_fixture(spark):
    """Two strata of 90 and 10, all right and all wrong, against a reader bit of 0 and 1."""
    s = spark.createDataFrame([("x", "0", 90, 1.0), ("x", "1", 10, 0.0)], "state string, bits string, N long, mean double")
    value = lambda **k: calibration.weighted_mean(s, "state", F.col("mean"), **k).first().value
    assert value() == pytest.approx(0.9)
    assert value(select=F.col("bits") == "1", complement=True) == pytest.approx(0.1)
    assert value(select=F.col("bits") == "0") == pytest.approx(0.9)


def test_kappa(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "b"), ("a", "b")], "x string, y string")
    r = calibration.kappa(d, [], "x", "y", F.lit(1)).first()
    assert (r.observed, r.expected, r.kappa) == pytest.approx((0.75, 0.5, 0.5))
    same = calibration.kappa(d.where("x = 'a' AND y = 'a'"), [], "x", "y", F.lit(1)).first()
    assert same.kappa is None


def test_agreement_types(spark):
    b = lambda v: F.lit(v)
    kinds = [one(spark, calibration.agreement_type(b(a), b(s), b(c), b(f))) for a, s, c, f in ((True, True, True, True), (False, True, True, True), (True, False, True, True), (True, True, False, True), (True, True, True, False), (False, False, True, True))]
    assert kinds == ["FULL_AGREEMENT", "ANSWER_DISAGREEMENT", "STATUS_DISAGREEMENT", "CORRECTNESS_DISAGREEMENT", "MULTIPLE_DISAGREEMENTS", "MULTIPLE_DISAGREEMENTS"]


def test_bootstrap_indices(spark):
    """The first row of the shared index matrix."""
    import numpy as np

    index = np.random.Generator(np.random.PCG64(20260909)).integers(0, 500, size=(500, 500), dtype=np.int32)
    assert index[0, :6].tolist() == [291, 499, 397, 232, 44, 51]
    d = spark.createDataFrame([("c", i, i % 2) for i in range(500)], "cell string, position long, v int")
    r = contrasts.bootstrap(d, ["cell"], "v", replicates=1000).first()
    assert r.mean == 0.5 and 0.44 < r.ci_low < 0.48 and 0.52 < r.ci_high < 0.56


def test_bootstrap_query_takes_all_replicates(spark, data):
    """Every cell's interval is that of 20,000 replicates."""
    import numpy as np

    from gaugeworks.plans.scoring import _pairs

    cells = {}
    for r in _pairs(spark, data).collect():
        cells.setdefault((r.request, r.id // 500), []).append((r.id, r.r - r.b))
    got = plans.QUERIES["bootstrap_ci"](spark, data).collect()
    assert {(r.request, r.block) for r in got} == set(cells)
    for r in got:
        x = np.array([d for _, d in sorted(cells[r.request, r.block])], float)
        rng = np.random.Generator(np.random.PCG64(20260909))
        means = np.concatenate([x[rng.integers(0, len(x), size=(500, len(x)), dtype=np.int32)].mean(axis=1) for _ in range(40)])
        assert (r.ci_low, r.ci_high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=1e-12)
