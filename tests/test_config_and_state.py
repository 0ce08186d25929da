from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import rewards
from gaugeworks.operators import builders, config, gates

GOOD = {"max_prompt_length": 512, "max_response_length": 1024, "max_model_length": 1536, "epsilon": 0.1, "proposal_exponent": 1.0, "condition": "iid"}
STRICT = {"sampling_enabled": True, "adv_estimator": "grpo", "loss_agg_mode": "seq-mean-token-mean", "train_batch_size": 32, "ppo_mini_batch_size": 32}


def test_launch_parameters():
    assert config.launch_problems(GOOD) == []
    assert len(config.launch_problems(GOOD | {"max_prompt_length": "x", "epsilon": 0, "proposal_exponent": float("nan"), "condition": "other"})) == 4
    assert config.launch_problems(GOOD | {"max_model_length": 100}) and config.launch_problems(GOOD | {"condition": "replay_corrected"}) and config.launch_problems(GOOD | {"condition": "oracle_corrected"})


@pytest.mark.parametrize("change", [{"apply_importance_correction": False}, {"adv_estimator": "gae"}, {"entropy_coeff": 0.1}, {"use_kl_loss": True}, {"ppo_epochs": 2}, {"ppo_mini_batch_size": 16}, {"train_batch_size": None}, {"loss_agg_mode": "token-mean"}, {"loss_mode": "other"}])
def test_strict_mode(change):
    assert config.strict_problems(STRICT) == []
    with pytest.raises(gates.GateError):
        config.require(config.strict_problems(STRICT | change))
    assert config.strict_problems(STRICT | change | {"strict_target_preservation": False}) == []


def test_state_restore(spark, tmp_path):
    strata = spark.createDataFrame([(0, 0.25, 0.5, 1.0), (1, 0.75, 0.5, 2.0)], "stratum long, target double, proposal double, second_moment double")
    config.sampler_state(strata, "r", 7, 2.0, True).write.parquet(str(tmp_path / "s"))
    saved = spark.read.parquet(str(tmp_path / "s"))
    problems = lambda s, t, e=2.0, a=True: sorted(r[0] for r in config.state_problems(s, t, e, a).collect())
    assert problems(saved, strata) == []
    assert problems(saved, strata, 1.0, False) == ["adaptation mode", "proposal exponent"]
    assert problems(saved.where("stratum = 0"), strata) == ["proposal", "proposal mass", "second moments", "strata"]
    assert problems(saved, strata.withColumn("target", F.lit(0.5))) == ["target"]


def test_locks_and_paths(spark):
    a = spark.createDataFrame([("s", "x", None), ("t", "y", "z"), ("u", "v", "w")], "id string, f string, g string")
    b = spark.createDataFrame([("s", "x", None), ("t", "y", None)], "id string, f string, g string")
    assert sorted(r.detail for r in gates.locked_unchanged(a, b, "id", ["f", "g"]).collect()) == ["t: g", "u: row"]
    p = spark.createDataFrame([("/a/b",), ("/a/../c",), ("/ab",)], "path string")
    assert sorted(r.detail for r in gates.contained(p, "/a").collect()) == ["/a/../c", "/ab"]


def test_render_items(spark):
    row = lambda i, split, text: ([("user", text)], ("7",), ("q", "a", i, split), 1, 0.5)
    d = spark.createDataFrame([row(0, "test", "q after"), row(1, "train", "q after"), row(2, "test", "other after")], "prompt array<struct<role:string,content:string>>, reward_model struct<ground_truth:string>, extra_info struct<question:string,answer:string,index:bigint,split:string>, difficulty_bin int, frozen_baseline_solve_rate double")
    items, bad = builders.render_items(d, "hash", {"hash": " after"})
    assert [(r.id, r.ground_truth, r.meta.difficulty_bin) for r in items.collect()] == [(0, "7", 1)]
    assert sorted(r.id for r in bad.collect()) == [1, 2]


def test_exact_samples(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(100)]
    got = builders.exact_srs(spark.createDataFrame(rows, "id long, h string"), "h", "id", 7, "20260716", "state").collect()
    for h in "ab":
        ids = sorted((i for i, x in rows if x == h), key=str)
        assert [r.id for r in sorted(got, key=lambda r: r.draw) if r.h == h] == random.Random(f"20260716:state:{h}").sample(ids, 7)
    assert builders.seeded_order(list(range(10)), 83) == [6, 5, 2, 4, 0, 3, 8, 1, 9, 7]


def test_reward_functions(spark):
    rewards.register(spark)
    spark.createDataFrame([("d", "so \\boxed{1,000}", "1000", None), ("d", None, "1", None), ("d", "\\boxed{2}", "3", None)], "d string, s string, g string, e string").createOrReplaceTempView("rewarded")
    assert [r[0] for r in spark.sql("SELECT boxed_reward(d, s, g, e) FROM rewarded").collect()] == [1.0, 0.0, 0.0]
    assert spark.sql("SELECT first_hash('#### 1,234')").first()[0] == "1234"
