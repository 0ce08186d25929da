"""Data builders: prompt rewrites, arms, contamination, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.readers import strip

MARKER = "\n#### "


def suffix_rewrite(text: Column, old: str, new: str) -> Column:
    """The text with its end `old` replaced by `new`; null where it doesn't end so."""
    return F.when(F.endswith(text, F.lit(old)), F.concat(F.left(text, F.length(text) - len(old)), F.lit(new)))


def rewrite_prompt(prompt: Column, old: str, new: str) -> Column:
    """suffix_rewrite over the only user turn of a prompt (array of role and content); null for any other shape."""
    turns = F.transform(prompt, lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "user", suffix_rewrite(m["content"], old, new)).otherwise(m["content"]).alias("content")))
    users = F.filter(prompt, lambda m: m["role"] == "user")
    return F.when((F.size(users) == 1) & F.forall(turns, lambda m: m["content"].isNotNull()), turns)


def question_between(text: Column, begin: str, end: str, suffix: str) -> Column:
    """What stands between two chat markers, without the convention's suffix."""
    inner = F.substring_index(F.substring_index(text, begin, -1), end, 1)
    return F.coalesce(suffix_rewrite(inner, suffix, ""), inner)


def split_answer(text: Column) -> tuple[Column, Column]:
    """Body and trimmed answer around the last marker; null without a marker or an answer."""
    whole = r"(?s)^(.*)\n#### (.*)$"
    body, answer = F.regexp_extract(text, whole, 1), strip(F.regexp_extract(text, whole, 2))
    fits = text.rlike(whole) & (answer != "")
    return F.when(fits, body), F.when(fits, answer)


def render_arm(body: Column, answer: Column, arm: str) -> Column:
    return F.concat(body, F.lit(MARKER), answer) if arm == "hash" else F.concat(body, F.lit("\n\\boxed{"), answer, F.lit("}"))


def normalized(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(text, r"(?U)\s+", " ")))


def contamination(train: DataFrame, evaluation: DataFrame, train_text: str, eval_text: str) -> DataFrame:
    """Normalised texts of both tables, once each."""
    a = train.select(normalized(F.col(train_text)).alias("text"))
    b = evaluation.select(normalized(F.col(eval_text)).alias("text"))
    return a.join(b, "text", "left_semi").distinct()


def arm_violations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys whose questions differ between arms, or whose bodies differ before the marker."""
    body = lambda c: F.regexp_extract(c, r"(?s)^(.*)\n(?:#### |\\boxed\{)", 1)
    both = a.join(b.select(key, F.col("question").alias("_q"), F.col("completion").alias("_c")), key, "full")
    bad = ~F.col("question").eqNullSafe(F.col("_q")) | ~body(F.col("completion")).eqNullSafe(body(F.col("_c")))
    return both.where(bad).select(key)


def column_changes(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of which some column that should be carried along has changed."""
    other = b.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(other, F.col(key) == F.col("_k"), "full").where(~same | F.col("_k").isNull() | F.col(key).isNull()).select(F.coalesce(key, "_k").alias(key))


def micro_batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """batch: positions in blocks of `size`, for gapless 0-based positions in `order`."""
    return rows.withColumn("batch", F.expr(f"{order} div {size}"))


def render_items(rows: DataFrame, convention: str, suffixes: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(items, violations) of test rows: index and split, one user turn that ends with the convention's suffix after the question."""
    suffix = suffixes[convention]
    turn, info = F.element_at("prompt", 1), F.col("extra_info")
    shaped = (F.size("prompt") == 1) & (turn["role"] == "user")
    asked = F.coalesce(suffix_rewrite(turn["content"], suffix, "") == info["question"], F.lit(False))
    ok = F.coalesce((info["split"] == "test") & shaped & asked & info["index"].isNotNull(), F.lit(False))
    items = rows.where(ok).select(info["index"].alias("id"), turn["content"].alias("prompt"), F.col("reward_model.ground_truth").cast("string").alias("ground_truth"), F.struct("difficulty_bin", "frozen_baseline_solve_rate").alias("meta"))
    return items, rows.where(~ok).select(info["index"].alias("id"))


def seeded_order(values: list, seed: int | str) -> list:
    """A copy in the order of a Mersenne Twister shuffle; for lists of a sample's size."""
    import random

    out = list(values)
    random.Random(seed).shuffle(out)
    return out


def exact_srs(rows: DataFrame, stratum: str, row_id: str, cap: int, seed: str, state: str) -> DataFrame:
    """Samples of at most cap rows per stratum by a Mersenne Twister seeded with seed:state:stratum over ids in text order.

    The draw depends only on a stratum's size, so positions are drawn on the driver from the sizes (one row per stratum),
    and rows are numbered by ranks per slice; no stratum is gathered."""
    import random

    from pyspark.sql import Window

    key = F.col(row_id).cast("string")
    keyed = rows.withColumn("_key", key).withColumn("_slice", F.left(key, F.lit(3)))
    sizes = keyed.groupBy(stratum, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(stratum).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(stratum, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    counts = sizes.groupBy(stratum).agg(F.sum("_n").alias("n")).collect()
    drawn = [(r[0], at, n) for r in counts for n, at in enumerate(random.Random(f"{seed}:{state}:{r[0]}").sample(range(r["n"]), min(cap, r["n"])))]
    picks = rows.sparkSession.createDataFrame(drawn, f"_h {rows.schema[stratum].dataType.simpleString()}, _at long, draw int")
    place = F.row_number().over(Window.partitionBy(stratum, "_slice").orderBy("_key")) - 1
    ranked = keyed.withColumn("_place", place).join(starts, [stratum, "_slice"]).withColumn("_place", F.col("_place") + F.col("_start"))
    return ranked.join(picks, (F.col(stratum) == F.col("_h")) & (F.col("_place") == F.col("_at"))).select(*rows.columns, "draw")


def row_receipts(rows: DataFrame, part: str, key: str) -> DataFrame:
    """name, sha256, rows: a receipt per part over all of its keys (whole numbers; equal keys count as often as they occur).

    Digests of up to 4,096 successive key values are hashed in order, then those of up to 4,096 such ranges, then those
    of a part, so no list grows with the rows of a part. Every range's number is hashed with its digest.
    """
    k = F.col(key).cast("long")
    level = rows.select(F.col(part).alias("name"), k.alias("at"), F.coalesce(k.cast("string"), F.lit("null")).alias("own"))
    level = level.groupBy("name", "at").agg(F.sha2(F.first("own"), 256).alias("h"), F.count(F.lit(1)).alias("rows"))
    level = level.withColumn("h", F.concat_ws("x", "h", "rows"))
    for _ in range(2):
        level = _ranges(level.withColumn("to", F.shiftright("at", 12)), ["name", "to"]).withColumnRenamed("to", "at")
    return _ranges(level, ["name"]).select("name", F.col("h").alias("sha256"), "rows")


def _ranges(level: DataFrame, by: list[str]) -> DataFrame:
    own = F.struct("at", F.concat_ws(":", F.col("at").cast("string"), "h").alias("h"))
    own = level.groupBy(*by).agg(F.array_sort(F.collect_list(own)).alias("r"), F.sum("rows").alias("rows"))
    return own.select(*by, F.sha2(F.array_join(F.transform("r", lambda x: x["h"]), ","), 256).alias("h"), "rows")


def merged(df: DataFrame, left: str, right: str) -> Column:
    """One struct of two: fields of the right one replace those of the left one under the same name, new ones follow."""
    names = {c: [f.name for f in df.schema[c].dataType.fields] for c in (left, right)}
    own = [F.col(f"{right if n in names[right] else left}.`{n}`").alias(n) for n in names[left]]
    return F.struct(*own, *[F.col(f"{right}.`{n}`").alias(n) for n in names[right] if n not in names[left]])
