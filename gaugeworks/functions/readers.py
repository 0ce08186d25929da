"""Answer readers and comparisons as Column builders.

Each reader has its own rule for which match counts, how far it looks and whether braces nest; they are kept apart on
purpose. "No answer" is null from readers and false from comparisons, never null.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the readers. (?U): Unicode digits and white space; (?d): only \n ends a line.
HASH_NUMBER = r"(?U)####\s*(-?\d+\.?\d*)"
NOVEL_NUMBER = r"(?U)@@@\s*(-?\d+\.?\d*)"
NUMBER = r"(?U)-?\d+\.?\d*"
HASH_ANY = r"(?Ud)####\s*(.+)"
HASH_LINE = r"(?U)####[^\S\n]*([^\n]*)"
FLAT_BOX = r"\\boxed\{([^{}]*)\}"
FLEXIBLE = r"-?[0-9.,]+"
FLOAT = r"(?i)^[+-]?(?:(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|nan|inf|infinity)$"
SIMPLE = r"^-?[0-9]+\.?[0-9]*$"
BOX = "\\boxed{"
TAIL = 300
TOLERANCE = 1e-3


#: White space, as str.strip takes it.
SPACES = "".join(chr(i) for i in range(1 << 16) if chr(i).isspace())
#: Decimal digits beyond ASCII, and their values.
DIGITS = "".join(chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.decimal(chr(i), None) is not None)
VALUES = "".join(str(unicodedata.decimal(c)) for c in DIGITS)


def once(values: list[Column], use: Callable[..., Column]) -> Column:
    """use(*values) with each value computed once a row, however often `use` names it: a projection's expressions would be
    copied to wherever they are named."""
    bound = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.get(F.transform(bound, lambda x: use(*[x[f"v{i}"] for i in range(len(values))])), F.lit(0))


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """All white space at both ends (trim takes spaces only)."""
    return F.btrim(c, F.lit(SPACES))


def without_commas(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def tail(c: Column, n: int = TAIL) -> Column:
    return F.right(c, F.lit(n))


def matches(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


# hash markers


def first_hash(text: Column) -> Column:
    """The first number after ####; white space between may cross lines."""
    return none_if_empty(F.regexp_extract(without_commas(text), HASH_NUMBER, 1))


def last_hash(text: Column) -> Column:
    return last(matches(without_commas(text), HASH_NUMBER, 1))


def hash_any(text: Column) -> Column:
    """What follows the first #### on its line or the next, trimmed; may be any text."""
    found = F.regexp_extract(text, HASH_ANY, 1)
    return F.when(text.rlike(HASH_ANY), strip(found))


def tail_hash(text: Column, n: int = TAIL) -> Column:
    """Last number after #### within the last n characters, without $ and commas."""
    return last(matches(F.translate(tail(text, n), ",$", ""), HASH_NUMBER, 1))


def hash_line(text: Column, which: str = "first") -> Column:
    """The rest of the line after the first or last ####, trimmed; empty is none."""
    found = matches(text, HASH_LINE, 1)
    return none_if_empty(strip(F.get(found, F.lit(0)) if which == "first" else last(found)))


def novel(text: Column) -> Column:
    """first_hash with the marker @@@."""
    return none_if_empty(F.regexp_extract(without_commas(text), NOVEL_NUMBER, 1))


# boxes


def closed_part(text: Column, escapes: bool) -> Column:
    """What stands before the brace that closes one open brace; null if none does. One step a brace. With escapes, a brace
    behind an odd run of backslashes is text."""
    # parts end in a brace, but for one with all that follows and a space: were that no match, a search would start anew at
    # each of its characters and read to the end
    pattern = r"(?s)(?:[^{}\\]++|\\.)*+[{}]?+" if escapes else r"[^{}]*+[{}]?+"
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("taken"))

    def step(s: Column, part: Column) -> Column:
        end = F.right(part, F.lit(1))
        return F.when(s["depth"] == 0, s).otherwise(F.struct((s["depth"] + F.when(end == "{", 1).when(end == "}", -1).otherwise(0)).alias("depth"), (s["taken"] + F.length(part)).alias("taken")))

    def closed(t: Column) -> Column:
        return F.aggregate(F.regexp_extract_all(F.concat(t, F.lit(" ")), F.lit(pattern), F.lit(0)), start, step, lambda s: F.when(s["depth"] == 0, F.left(t, s["taken"] - 1)))

    return once([text], closed)


def boxed(text: Column) -> Column:
    """Contents of the first \\boxed{...}, braces matched; an unclosed box is none, an empty one is empty."""
    at = F.instr(text, BOX)
    return F.when(at > 0, closed_part(F.substr(text, at + len(BOX)), False))


def boxed_payload(text: Column, which: str = "first") -> Column:
    """Contents of the first or last \\boxed {...} (white space allowed), braces matched, trimmed; empty is none."""
    pattern = r"(?Us)\\boxed\s*\{(.*)$" if which == "first" else r"(?Us)^(?:.*)\\boxed\s*\{(.*)$"
    # the condition stands inside: behind it nullif would compute the contents twice
    return none_if_empty(F.when(text.rlike(r"(?U)\\boxed\s*\{"), strip(closed_part(F.regexp_extract(text, pattern, 1), False))))


def flat_box(text: Column, n: int = TAIL) -> Column:
    """Last \\boxed{...} without inner braces within the last n characters, without $ and commas, trimmed."""
    found = last(matches(tail(text, n), FLAT_BOX, 1))
    return F.translate(strip(found), ",$", "")


def flexible_number(text: Column, n: int = TAIL) -> Column:
    """Last run of digits, dots and commas (a minus before it) in the tail that isn't empty or "."; if all are such, the first of them."""
    runs = matches(tail(text, n), FLEXIBLE, 0)
    good = F.filter(runs, lambda x: ~x.isin("", "."))
    return F.coalesce(last(good), F.get(runs, F.lit(0)))


# numbers


def last_number(text: Column) -> Column:
    return last(matches(without_commas(text), NUMBER, 0))


def _plain(c: Column) -> Column:
    """ASCII digits for others."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, DIGITS, VALUES)).otherwise(c)


def number(c: Column) -> Column:
    """The value of a text that is a number as a whole (nan and infinity are), else null."""

    def value(bare: Column) -> Column:
        text = F.regexp_replace(F.replace(_plain(bare), F.lit("_"), F.lit("")), "(?i)inf(inity)?", "Infinity")
        return F.when(bare.rlike(SIMPLE), bare.try_cast("double")).when(bare.rlike("(?U)" + FLOAT), text.try_cast("double"))

    return once([strip(c)], value)


def _close(x: Column, y: Column) -> Column:
    """Nothing is within a tolerance of nan or infinity."""
    return ~F.isnan(x - y) & (F.abs(x - y) < TOLERANCE)


def numeric_equal(a: Column, b: Column) -> Column:
    """Numbers within an absolute tolerance, other texts by equality after trimming; false if either is none."""

    def equal(x: Column, y: Column) -> Column:
        return once([number(x), number(y)], lambda p, q: F.when(p.isNotNull() & q.isNotNull(), _close(p, q)).otherwise(strip(x) == strip(y)))

    return F.coalesce(once([a, b], equal), F.lit(False))


def extracted_equal(found: Column, gold: Column) -> Column:
    """numeric_equal for what a number's pattern has matched, and a gold answer's number(): a text that isn't a number can't
    equal one that is."""
    return F.coalesce(_close(_plain(found).try_cast("double"), gold), F.lit(False))


def reference(truth: Column) -> Column:
    """A gold answer: its hash number, else its last number, else its text."""
    return F.coalesce(first_hash(truth), last_number(truth), truth)


def gold_number(truth: Column) -> Column:
    return once([reference(truth)], number)


def verdicts(response: Column, truth: Column, box: bool = False) -> Column:
    """struct(strict, lenient), and boxed if asked for, with each extraction made once."""

    def judged(h: Column, n: Column, gold: Column, *boxes: Column) -> Column:
        return F.struct(extracted_equal(h, gold).alias("strict"), extracted_equal(F.coalesce(h, n), gold).alias("lenient"), *[extracted_equal(b, gold).alias("boxed") for b in boxes])

    return once([first_hash(response), last_number(response), gold_number(truth), *([last_number(boxed(response))] if box else [])], judged)


# verdicts


def strict(response: Column, truth: Column) -> Column:
    return once([first_hash(response), gold_number(truth)], extracted_equal)


def lenient(response: Column, truth: Column) -> Column:
    return once([F.coalesce(first_hash(response), last_number(response)), gold_number(truth)], extracted_equal)


def boxed_strict(response: Column, truth: Column) -> Column:
    return once([last_number(boxed(response)), gold_number(truth)], extracted_equal)


def novel_strict(response: Column, truth: Column) -> Column:
    return once([novel(response), gold_number(truth)], extracted_equal)


def boxed_reward(response: Column, truth: Column, score: float = 1.0, format_score: float = 0.0, method: str = "strict") -> Column:
    """score for an exactly equal box, format_score for another box, 0 without one."""
    found = flat_box(response) if method == "strict" else flexible_number(response)
    return F.when(found.isNull(), 0.0).when(found == truth, score).otherwise(format_score)


def lenient_reward(response: Column, truth: Column, score: float = 1.0) -> Column:
    return F.when(F.coalesce(lenient(response, truth), F.lit(False)), score).otherwise(0.0)


def score_fields(response: Column, truth: Column) -> dict[str, Column]:
    """The nine fields of a response's score row."""
    made = score_struct(response, truth)
    return {name: made[name] for name in SCORE_FIELDS}


# The fields' names.
SCORE_FIELDS = ("strict_first_hash", "strict_last_hash", "frozen_lenient", "last_number", "hash_parseable", "marker_present", "extracted_first_hash", "extracted_last_hash", "extracted_last_number")


def score_struct(response: Column, truth: Column) -> Column:
    """The same as one struct, with each extraction made once."""

    def judged(r: Column, first: Column, final: Column, n: Column, gold: Column) -> Column:
        fields = (extracted_equal(first, gold), extracted_equal(final, gold), extracted_equal(F.coalesce(first, n), gold), extracted_equal(n, gold), first.isNotNull(), F.contains(r, F.lit("####")), first, final, n)
        return F.struct(*[c.alias(name) for name, c in zip(SCORE_FIELDS, fields, strict=True)])

    return once([response, first_hash(response), last_hash(response), last_number(response), gold_number(truth)], judged)


Verdict = Callable[[Column, Column], Column]

#: Readers without the symbolic engine; gaugeworks.functions.symbolic adds the tasks that need it.
SCORERS: dict[str, dict[str, Verdict]] = {
    "gsm8k": {"strict": strict, "lenient": lenient},
    "gsm8k_boxed": {"strict": boxed_strict, "lenient": lenient},
    "gsm8k_novel": {"strict": novel_strict, "lenient": lenient},
}
