"""Run configuration gates and the sampler's saved state: small documents, checked on the driver."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.gates import GateError
from gaugeworks.operators.sampling import CONDITIONS

STATE_VERSION = 2


def launch_problems(config: dict[str, Any]) -> list[str]:
    """What is wrong with a run's parameters, all of it."""
    bad = []

    def whole(name: str) -> int | None:
        try:
            value = int(config.get(name, ""))
        except (TypeError, ValueError):
            value = 0
        if value <= 0:
            bad.append(f"{name} must be a positive whole number")
        return value if value > 0 else None

    prompt, response = whole("max_prompt_length"), whole("max_response_length")
    if config.get("max_model_length") and prompt and response and int(config["max_model_length"]) < prompt + response:
        bad.append("max_model_length is below prompt and response together")
    epsilon, exponent = float(config.get("epsilon", 0.1)), float(config.get("proposal_exponent", 1.0))
    if not (math.isfinite(epsilon) and 0 < epsilon <= 1):
        bad.append("epsilon must be in (0, 1]")
    if not (math.isfinite(exponent) and exponent >= 0):
        bad.append("proposal_exponent must be finite and not negative")
    condition = config.get("condition")
    if condition not in CONDITIONS:
        bad.append(f"unknown condition {condition}")
    elif condition.startswith("replay") and not config.get("proposal_schedule"):
        bad.append("replays need a proposal schedule")
    elif condition == "oracle_corrected" and not config.get("oracle_stratum_weights"):
        bad.append("the oracle condition needs its weights")
    return bad


def strict_problems(config: dict[str, Any]) -> list[str]:
    """Settings under which corrected sampling wouldn't keep the target; none where strict mode is off."""
    if not config.get("sampling_enabled", False) or not config.get("strict_target_preservation", True):
        return []
    wanted = {
        "apply_importance_correction": (True, True),
        "adv_estimator": (None, "grpo"),
        "entropy_coeff": (0.0, 0.0),
        "use_kl_loss": (False, False),
        "ppo_epochs": (1, 1),
        "loss_agg_mode": (None, "seq-mean-token-mean"),
        "loss_mode": ("vanilla", "vanilla"),
    }
    bad = [f"{name} must be {value}" for name, (default, value) in wanted.items() if config.get(name, default) != value]
    batch, mini = config.get("train_batch_size"), config.get("ppo_mini_batch_size")
    if batch is None or mini is None or int(batch) != int(mini):
        bad.append("ppo_mini_batch_size must be given and equal train_batch_size")
    return bad


def require(problems: list[str]) -> None:
    if problems:
        raise GateError("; ".join(problems))


def sampler_state(strata: DataFrame, run: str, draws: int, exponent: float, adaptive: bool) -> DataFrame:
    """One row per stratum (columns stratum, target, proposal, second_moment) with the run's settings, to be written as a table."""
    own = strata.select("stratum", *[F.col(c).cast("double").alias(c) for c in ("target", "proposal", "second_moment")])
    return own.select("*", F.lit(run).alias("run"), F.lit(STATE_VERSION).alias("version"), F.lit(draws).cast("long").alias("draw_count"), F.lit(exponent).cast("double").alias("proposal_exponent"), F.lit(adaptive).alias("adaptation_enabled"))


def state_problems(saved: DataFrame, strata: DataFrame, exponent: float, adaptive: bool) -> DataFrame:
    """Why a saved state doesn't fit the current strata and settings: (problem), one row each. Version 1 had exponent 1."""
    now = strata.select(F.col("stratum").alias("_s"), F.col("target").alias("_t"))
    both = saved.join(now, F.col("stratum").eqNullSafe(F.col("_s")), "full")
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    row = {
        "version": ~F.col("version").isin(1, STATE_VERSION),
        "proposal exponent": F.when(F.col("version") == 1, 1.0).otherwise(F.col("proposal_exponent")) != exponent,
        "adaptation mode": F.col("adaptation_enabled") != adaptive,
        "strata": F.col("stratum").isNull() | F.col("_s").isNull(),
        "target": F.abs(F.col("target") - F.col("_t")) > 1e-15,
        "proposal": ~finite("proposal") | (F.col("proposal") < 0) | ((F.col("_t") > 0) & (F.col("proposal") <= 0)),
        "second moments": ~finite("second_moment") | (F.col("second_moment") <= 0),
        "draw count": F.col("draw_count") < 0,
    }
    flags = both.agg(*[F.coalesce(F.max(c), F.lit(False)).alias(n) for n, c in row.items()], (F.abs(F.coalesce(F.sum("proposal"), F.lit(0.0)) - 1) > 1e-12).alias("proposal mass"))
    names = [*row, "proposal mass"]
    return flags.unpivot([], names, "problem", "found").where("found").select("problem")
