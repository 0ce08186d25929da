"""Rewards as SQL functions, under the argument order of external trainers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import readers


def register(spark: SparkSession) -> None:
    """boxed_reward(data_source, solution, ground_truth, extra_info) in Arrow batches, and first_hash(text) as a SQL
    function over built-in expressions, which Catalyst inlines."""

    import re

    flat, tail = re.compile(readers.FLAT_BOX), readers.TAIL

    def boxed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for _, solution, truth, _ in batches:
            found = solution.fillna("").str[-tail:].map(lambda t: (flat.findall(t) or [None])[-1])
            own = found.map(lambda x: None if x is None else x.strip().replace(",", "").replace("$", ""))
            yield ((own == truth) & own.notna()).astype(float)

    spark.udf.register("boxed_reward", F.pandas_udf(boxed, "double"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION first_hash(t STRING) RETURNS STRING RETURN nullif(regexp_extract(replace(t, ',', ''), '####\\\\s*(-?\\\\d+\\\\.?\\\\d*)', 1), '')")
