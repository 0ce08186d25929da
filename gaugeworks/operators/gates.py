"""Gates: each returns a DataFrame of violations (gate, detail); require_empty() raises once over all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.readers import strip


class GateError(ValueError):
    pass


def _said(rows: DataFrame, gate: str, detail: Column) -> DataFrame:
    return rows.select(F.lit(gate).alias("gate"), detail.cast("string").alias("detail"))


def predicate(rows: DataFrame, gate: str, ok: Column, detail: Column) -> DataFrame:
    """Rows where ok is false or null."""
    return _said(rows.where(~F.coalesce(ok, F.lit(False))), gate, detail)


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return _said(rows.groupBy(*keys).count().where("count > 1"), "duplicate", F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))


def cover(rows: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Missing and unknown keys, both ways, and duplicates."""
    missing = _said(expected.select(key).join(rows.select(key), key, "left_anti"), "missing", F.col(key))
    unknown = _said(rows.select(key).join(expected.select(key), key, "left_anti"), "unknown", F.col(key))
    return missing.union(unknown).union(duplicates(rows, key))


def same_values(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Groups in which fields that should be constant differ."""
    groups = rows.groupBy(*by) if by else rows.groupBy()
    return _said(groups.agg(F.count_distinct(F.struct(*fields)).alias("_k")).where("_k > 1"), "differs", F.concat_ws(",", F.lit("group"), *[F.col(c).cast("string") for c in by]))


def all_or_none(rows: DataFrame, field: str) -> DataFrame:
    n = rows.agg(F.count(field).alias("has"), F.count(F.lit(1)).alias("all"))
    return _said(n.where("has > 0 AND has < all"), "partly present", F.lit(field))


def equal_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other hasn't as often."""
    left, right = a.exceptAll(b), b.exceptAll(a)
    text = lambda df: F.to_json(F.struct(*df.columns))
    return _said(left, "only left", text(left)).union(_said(right, "only right", text(right)))


def implications(rows: DataFrame, row_id: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows that meet a rule's condition but not its consequence."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)) & ~F.coalesce(q, F.lit(False)), F.lit(name)) for name, (c, q) in rules.items()]))
    found = rows.select(F.col(row_id).cast("string").alias("_id"), F.explode(broken).alias("_rule"))
    return _said(found, "implication", F.concat_ws(": ", "_id", "_rule"))


# Vocabularies of labels.
STATUSES = ("CLEAR_ANSWER", "NO_ANSWER", "UNRESOLVED_CONFLICT", "AMBIGUOUS")
CORRECTNESS = ("CORRECT", "INCORRECT", "UNRESOLVED")
FIDELITIES = ("FAITHFUL", "UNFAITHFUL", "UNRESOLVED", "NOT_APPLICABLE")
AGREEMENTS = ("FULL_AGREEMENT", "ANSWER_DISAGREEMENT", "STATUS_DISAGREEMENT", "CORRECTNESS_DISAGREEMENT", "MULTIPLE_DISAGREEMENTS")


def label_vocabularies(applies: tuple[str, ...] = ("A_", "B_")) -> dict[str, tuple[Column, Column]]:
    """The domains of a label row's further fields."""
    yes_no, text = ("YES", "NO"), ("committed_answer", "evidence_span", "notes")
    col, always = F.col, F.lit(True)
    rules = {c: (always, col(c).isin(*yes_no)) for c in ("final_has_conflict", "final_self_correction")}
    for who in applies:
        domains = {"status": STATUSES, "answer_correct": CORRECTNESS, "has_self_correction": yes_no, "has_conflicting_answer_fields": yes_no, "old_answer_explicitly_withdrawn": (*yes_no, "N/A"), "reference_issue": ("NO", "POSSIBLE_REFERENCE_ERROR")}
        rules |= {f"{who}{c}": (always, col(f"{who}{c}").isin(*values)) for c, values in domains.items()}
        rules |= {f"{who}{c}": (always, col(f"{who}{c}").isNotNull()) for c in text}
    return rules


def population_violations(strata: DataFrame, samples: DataFrame, accuracies: DataFrame) -> DataFrame:
    """gate, detail over states' strata (state, bits, size, quota, population), samples (state, stratum) and stated reader
    accuracies (state, position, accuracy): sums, quotas, observed counts and the accuracies that strata imply."""
    at = F.concat_ws("/", "state", "bits")
    seen = samples.groupBy("state", F.col("stratum").alias("bits")).agg(F.count(F.lit(1)).alias("seen"))
    both = strata.join(seen, ["state", "bits"], "full")
    quota, seen_n = F.coalesce("quota", F.lit(0)), F.coalesce("seen", F.lit(0))
    own = [
        (F.col("size").isNull(), "unknown stratum"),
        (~F.col("bits").rlike("^[01]+$"), "bits"),
        ((F.col("quota") < 0) | (F.col("quota") > F.col("size")) | (F.col("size") > 0) & (F.col("quota") == 0), "unsampled"),
        (F.col("size").isNotNull() & (quota != seen_n), "quota"),
    ]
    found = F.filter(F.array(*[F.when(bad, F.lit(g)) for bad, g in own]), lambda x: x.isNotNull())
    each = both.select(F.explode(found).alias("gate"), at.alias("detail"))
    sums = strata.groupBy("state").agg(F.sum("size").alias("s"), F.max("population").alias("p")).where("s <> p").select(F.lit("sum").alias("gate"), F.col("state").alias("detail"))
    right = F.sum(F.when(F.substring("bits", F.col("position") + 1, F.lit(1)) == "1", F.col("size")).otherwise(0))
    implied = strata.join(accuracies, "state").groupBy("state", "position").agg((right / F.max("population")).alias("implied"), F.max("accuracy").alias("accuracy"))
    off = implied.where("NOT coalesce(abs(implied - accuracy) < 1e-10, false)").select(F.lit("accuracy").alias("gate"), F.concat_ws("/", "state", "position").alias("detail"))
    return each.unionByName(sums).unionByName(off)


def archive_differences(now: DataFrame, archived: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """keys, count, recomputed, archived of every count that differs, or that one side lacks."""
    long = lambda d, name: d.select(*keys, *[F.col(c).cast("long").alias(c) for c in counts]).unpivot(keys, counts, "count", name)
    return long(now, "recomputed").join(long(archived, "archived"), [*keys, "count"], "full").where("NOT recomputed <=> archived")


def signer_violations(locks: DataFrame, adjudicator: str | None) -> DataFrame:
    """gate, detail over locks (who, stage, signer): annotators who change between stages, aren't distinct, or adjudicate."""
    name = lambda c: F.lower(strip(c))
    own = locks.select("who", name(F.col("signer")).alias("signer"))
    changed = own.groupBy("who").agg(F.count_distinct("signer").alias("k")).where("k > 1").select(F.lit("changed").alias("gate"), F.col("who").alias("detail"))
    shared = own.groupBy("signer").agg(F.count_distinct("who").alias("k")).where("k > 1").select(F.lit("not distinct").alias("gate"), F.col("signer").alias("detail"))
    third = name(F.lit(adjudicator).cast("string"))
    same = own.where(F.col("signer") == third).select(F.lit("adjudicates").alias("gate"), F.col("signer").alias("detail")).distinct()
    nobody = locks.sparkSession.range(1).where(F.coalesce(third, F.lit("")) == "").select(F.lit("no adjudicator").alias("gate"), F.lit("").alias("detail"))
    return changed.unionByName(shared).unionByName(same).unionByName(nobody)


def _inked(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) != ""


def label_rules(readers: tuple[str, ...] = ("strict", "fallback", "mv"), applicable: tuple[str, ...] = ("strict", "fallback", "mv")) -> dict[str, tuple[Column, Column]]:
    """What a final label must satisfy: vocabularies, and what a status implies for both annotators and the final label."""
    always, col = F.lit(True), F.col
    rules = {
        "final_status": (always, col("final_status").isin(*STATUSES)),
        "final_answer_correct": (always, col("final_answer_correct").isin(*CORRECTNESS)),
        "agreement_type": (always, col("agreement_type").isin(*AGREEMENTS)),
        "A_B_answer_equivalence": (always, col("A_B_answer_equivalence").isin("EQUIVALENT", "DIFFERENT", "UNRESOLVED")),
    }
    for who in ("A_", "B_"):
        status, correct = col(f"{who}status"), col(f"{who}answer_correct")
        rules |= {
            f"{who}clear answer is stated and shown": (status == "CLEAR_ANSWER", _inked(f"{who}committed_answer") & _inked(f"{who}evidence_span")),
            f"{who}no answer is incorrect": (status == "NO_ANSWER", correct == "INCORRECT"),
            f"{who}unclear answer is unresolved": (status.isin("UNRESOLVED_CONFLICT", "AMBIGUOUS"), (correct == "UNRESOLVED") & (_inked(f"{who}evidence_span") | _inked(f"{who}notes"))),
            f"{who}reference issue stays unresolved": (col(f"{who}reference_issue") == "POSSIBLE_REFERENCE_ERROR", correct == "UNRESOLVED"),
        }
    status, correct = col("final_status"), col("final_answer_correct")
    same = (col("A_status") == col("B_status")) & (col("A_answer_correct") == col("B_answer_correct")) & (col("A_B_answer_equivalence") == "EQUIVALENT")
    changed = (status != col("A_status")) | (correct != col("A_answer_correct"))
    rules |= {
        "final clear answer is stated": (status == "CLEAR_ANSWER", _inked("final_committed_answer")),
        "final no answer is incorrect": (status == "NO_ANSWER", correct == "INCORRECT"),
        "final unclear answer is unresolved": (status.isin("UNRESOLVED_CONFLICT", "AMBIGUOUS"), correct == "UNRESOLVED"),
        "full agreement fits the labels": (col("agreement_type") == "FULL_AGREEMENT", same),
        "disagreement has a reason": ((col("agreement_type") != "FULL_AGREEMENT") | changed, _inked("adjudication_reason")),
    }
    for reader in readers:
        fidelity = col(f"{reader}_fidelity")
        if reader not in applicable:
            rules[f"{reader} doesn't apply"] = (always, fidelity == "NOT_APPLICABLE")
            continue
        rules |= {
            f"{reader}_fidelity": (always, fidelity.isin(*FIDELITIES)),
            f"{reader} fidelity needs a clear answer": (status != "CLEAR_ANSWER", fidelity.isin("UNRESOLVED", "NOT_APPLICABLE")),
            f"{reader} clear answer has a fidelity": (status == "CLEAR_ANSWER", fidelity != "NOT_APPLICABLE"),
        }
    return rules


def chronology(locks: DataFrame) -> DataFrame:
    """Stage-two locks before the last stage-one lock, and times without a zone."""
    aware = F.col("utc").rlike(r"(Z|[+-]\d\d:\d\d)$")
    naive = _said(locks.where(~aware), "no time zone", F.concat_ws("/", "role", "stage"))
    last = locks.where(aware & (F.col("stage") == 1)).agg(F.max(F.to_timestamp("utc")).alias("_last"))
    early = locks.where(aware & (F.col("stage") == 2)).crossJoin(F.broadcast(last)).where(F.to_timestamp("utc") < F.col("_last"))
    return naive.union(_said(early, "too early", F.concat_ws("/", "role", "stage")))


def receipts_match(stated: DataFrame, found: DataFrame) -> DataFrame:
    """(name, sha256) that are missing or differ."""
    f = found.select("name", F.col("sha256").alias("_found"))
    return _said(stated.join(f, "name", "left").where(~F.col("sha256").eqNullSafe(F.col("_found"))), "receipt", F.col("name"))


def violations(*gates: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, gates)


def require_empty(found: DataFrame, shown: int = 5) -> None:
    """Raises with the number of violations per gate and the first few of all; nothing has been written before."""
    counts = {r["gate"]: r["count"] for r in found.groupBy("gate").count().collect()}  # one row per gate
    if counts:
        raise GateError(f"{counts}; for example {[tuple(r) for r in found.limit(shown).collect()]}")


def locked_unchanged(locks: DataFrame, final: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of locked rows that the final rows lack or have changed: one violation per row and field."""
    now = final.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    both = locks.join(now, F.col(key) == F.col("_k"), "left")
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]))
    found = both.select(F.col(key).cast("string").alias("_id"), F.explode(F.when(F.col("_k").isNull(), F.array(F.lit("row"))).otherwise(changed)).alias("_f"))
    return _said(found, "locked", F.concat_ws(": ", "_id", "_f"))


def contained(paths: DataFrame, root: str, column: str = "path") -> DataFrame:
    """Paths that leave a root folder or name a parent."""
    inside = F.startswith(F.col(column), F.lit(root.rstrip("/") + "/")) & ~F.col(column).rlike(r"(^|/)\.\.(/|$)")
    return predicate(paths, "outside", inside, F.col(column))


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """df, if it has all needed columns."""
    if missing := sorted(set(needed) - set(df.columns)):
        raise GateError(f"missing columns: {', '.join(missing)}")
    return df
