from __future__ import annotations

import collections
import hashlib

import pytest
from oracle import database, rows

from gaugeworks import plans
from gaugeworks.operators import detector, sampling
from gaugeworks.sources.fixtures import samples


@pytest.fixture(scope="module")
def duck(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, data, duck, name):
    got, want = plans.QUERIES[name](spark, data).toPandas(), duck.sql(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_blake2b_bins_by_hand(spark, data):
    """The bins of a plain sort by (solve count, digest of the id)."""
    scores = plans.QUERIES["rollout_scores"](spark, data).select("row_id", "solve_count").collect()
    tie = lambda i: hashlib.blake2b(f"difficulty-tie:{i}".encode(), digest_size=8).hexdigest()
    order = sorted(scores, key=lambda r: (r.solve_count, tie(r.row_id)))
    want = {r.row_id: min(k * 4 // len(order), 3) for k, r in enumerate(order)}
    assert {r.row_id: r.difficulty_bin for r in plans.QUERIES["balanced_bins_blake2b"](spark, data).collect()} == want


def test_candidates_by_hand(spark, data):
    """Every response of the table through the plain detector."""
    rows = samples(spark, data).select("id", "sample", "response").collect()
    want = [(r.id, r.sample, *c) for r in rows for c in detector.detect(r.response)["candidates"]]
    got = [tuple(r) for r in plans.QUERIES["payload_candidates"](spark, data).collect()]
    assert sorted(got) == sorted(want) and len(got) > 1000


def test_draws_follow_their_probabilities(spark, data):
    """Shares of a draw lie within five standard errors, and another split of the work draws the same."""
    strata = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2), ("d", 0.0)], "stratum string, p double")
    draws = {n: sampling.draw_categorical(strata, "stratum", "p", n, 7).orderBy("draw_number").collect() for n in (20_000, 5_000)}
    assert draws[20_000][:5_000] == draws[5_000]
    share = collections.Counter(r.stratum for r in draws[20_000])
    for name, p in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(share[name] / 20_000 - p) < 5 * (p * (1 - p) / 20_000) ** 0.5
    assert not share["d"]


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_gives_rows(spark, data, name):
    assert plans.QUERIES[name](spark, data).count() > 0
