"""Hash rules: BLAKE2b-64 order keys in Arrow batches, SHA-256 ones inside the JVM, and id and seed rules."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def blake2b64(text: Column) -> Column:
    """16 hex digits of the 8-byte BLAKE2b digest: they sort as the unsigned big-endian number does."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=8).hexdigest())

    return run(text)


def sha256_key(text: Column) -> Column:
    return F.sha2(text, 256)


def sample_id(seed: int, state: Column, row_id: Column) -> Column:
    """'H' and the first ten digits of SHA-256(seed:state:id), upper-cased."""
    return F.concat(F.lit("H"), F.upper(F.left(F.sha2(F.concat_ws(":", F.lit(str(seed)), state, row_id.cast("string")), 256), F.lit(10))))


def shard_seed(seed: int, row_id: Column) -> Column:
    """(seed * 1000003 + row_id) mod (2^31 - 1)."""
    return (F.lit(seed * 1_000_003).cast("long") + row_id.cast("long")) % (2**31 - 1)
