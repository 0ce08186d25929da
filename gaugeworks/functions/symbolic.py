"""Symbolic equality of LaTeX answers: an approximation of an external engine, for what can be decided exactly.

Numbers, fractions, roots of squares, percentages, tuples, sets and intervals compare as exact values, other answers as
normalised text. What can't be read gives null, upon which the readers fall back to the last number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from math import isqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.functions.readers import BOX, SCORERS, boxed, boxed_payload, hash_any, hash_line, last_number, numeric_equal, strip

WRAPS = (("$$", "$$"), ("$", "$"), ("\\(", "\\)"), ("\\[", "\\]"))
DROPPED = re.compile(r"\\(?:left|right|displaystyle|,|!|;|:| )|\\(?:text|mathrm|mbox)\s*\{\s*(?:units?|cm|m|feet|inches|degrees?)\s*\}|\^\s*\\?\{?\\circ\}?|~")
FRACTION = re.compile(r"\\[dt]?frac\s*(?:\{([^{}]*)\}|(\d))\s*(?:\{([^{}]*)\}|(\d))")
ROOT = re.compile(r"\\sqrt\s*(?:\{(\d+)\}|(\d))")
PLAIN = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)$")


def unwrapped(text: str) -> str:
    text = text.strip()
    for a, b in WRAPS:
        if len(text) >= len(a) + len(b) and text.startswith(a) and text.endswith(b):
            return text[len(a) : len(text) - len(b)].strip()
    return text


def value(text: str) -> Fraction | None:
    """An exact number, or null."""
    text = text.strip().rstrip(".")
    sign = -1 if text.startswith("-") else 1
    text = text.lstrip("+-").strip()
    share = text.endswith(("\\%", "%"))
    text = re.sub(r"\\?%$", "", text).strip()
    text = re.sub(r"(?<=\d)\{?,\}?(?=\d{3}(?:\D|$))", "", text).replace("\\$", "").strip()
    mixed = re.fullmatch(r"(\d+)\s*(\\[dt]?frac.*)", text)
    if mixed and (part := value(mixed[2])) is not None:
        number = Fraction(mixed[1]) + part
    elif f := FRACTION.fullmatch(text):
        top, bottom = value(f[1] or f[2] or ""), value(f[3] or f[4] or "")
        if top is None or not bottom:
            return None
        number = top / bottom
    elif (r := ROOT.fullmatch(text)) and isqrt(n := int(r[1] or r[2])) ** 2 == n:
        number = Fraction(isqrt(n))
    elif re.fullmatch(r"\d+\s*/\s*\d+", text):
        a, b = text.split("/")
        if not int(b):
            return None
        number = Fraction(int(a), int(b))
    elif PLAIN.fullmatch(text):
        number = Fraction(text)
    else:
        return None
    return sign * (number / 100 if share else number)


def parsed(payload: str | None) -> tuple | None:
    """A structure that compares by equality; null if there is nothing to read."""
    if payload is None:
        return None
    text = DROPPED.sub("", unwrapped(payload)).strip()
    text = re.sub(r"^\\(?:text|mathrm|mbox|textbf|mathbf)\s*\{(.*)\}$", r"\1", text).strip().rstrip(".")
    if "=" in text and re.match(r"^[A-Za-z]\w*\s*=", text):
        text = text.split("=", 1)[1].strip()
    if not text:
        return None
    n = value(text)
    if n is not None:
        return ("number", n)
    if text[0] in "([" and text[-1] in ")]" and "," in text:
        parts = tuple(parsed(p) for p in text[1:-1].split(","))
        return ("ordered", text[0], text[-1], parts)
    if text.startswith("\\{") and text.endswith("\\}"):
        return ("set", frozenset(parsed(p) for p in text[2:-2].split(",")))
    return ("text", re.sub(r"\s+", "", text.replace("\\dfrac", "\\frac").replace("\\tfrac", "\\frac")).casefold())


def same(gold: str, candidate: str | None) -> bool | None:
    """Whether two answers are equal; null where either can't be read. Other text than numbers, tuples and sets is read only
    as far as it is the same text."""
    a, b = parsed(gold), parsed(candidate)
    if a is None or b is None:
        return None
    return True if a == b else None if "text" in (a[0], b[0]) else False


def verdict(gold: Column, candidate: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for g, c in batches:
            yield pd.Series([None if x is None or y is None else same(x, y) for x, y in zip(g, c, strict=True)], dtype="boolean")

    return run(gold, candidate)


def _fallback(decided: Column, text: Column, truth: Column) -> Column:
    """A verdict, or else whether the last numbers are equal."""
    return F.coalesce(decided, numeric_equal(last_number(text), last_number(truth)))


def math_strict(response: Column, truth: Column) -> Column:
    """A box's marker is required; the contents of the first closed box decide, else the response's last number."""
    return F.when(F.contains(response, F.lit(BOX)), _fallback(verdict(truth, boxed(response)), response, truth)).otherwise(False)


def math_lenient(response: Column, truth: Column) -> Column:
    """The box if there is one, else the last line, else the response's last number."""
    line = F.try_element_at(F.split(strip(response), r"\R"), F.lit(-1))
    return F.when(F.contains(response, F.lit(BOX)), math_strict(response, truth)).otherwise(_fallback(verdict(truth, line), response, truth))


def math_hashes_strict(response: Column, truth: Column) -> Column:
    """What stands after the marker decides, else its last number."""
    tail = hash_any(response)
    return F.when(tail.isNull(), False).otherwise(_fallback(verdict(truth, tail), tail, truth))


def score_one(response: Column, truth: Column, convention: Column) -> dict[str, Column]:
    """Verdicts of a response under the requested and both conventions, with what could be extracted."""
    h, b = hash_line(response), boxed_payload(response)
    requested = F.when(convention == "hash", h).otherwise(b)
    judge = lambda c: F.coalesce(verdict(truth, c), F.lit(False))
    return {"strict": judge(requested), "hash_strict": judge(h), "boxed_strict": judge(b), "requested_extractable": requested.isNotNull(), "hash_payload": h, "boxed_payload": b}


ALL_SCORERS = SCORERS | {"math": {"strict": math_strict, "lenient": math_lenient}, "math_hashes": {"strict": math_hashes_strict, "lenient": math_lenient}}
