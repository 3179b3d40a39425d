"""Expansion of command grammar: ``a {b|c} [d]`` into its concrete forms."""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..scratch import spread
from . import text as T

_CLOSES = {"}": "{", "]": "["}


def pieces(value: str, at_bar: bool = False) -> list[str]:
    """Parts between blanks (or bars) that stand outside of balanced groups; empty ones dropped."""
    cuts, open_marks = [-1], []
    for i, c in enumerate(value):
        if c in "{[":
            open_marks.append(c)
        elif open_marks and _CLOSES.get(c) == open_marks[-1]:
            open_marks.pop()
        elif not open_marks and (c == "|" if at_bar else c.isspace()):
            cuts.append(i)
    cuts.append(len(value))
    parts = (value[a + 1 : b].strip() for a, b in zip(cuts, cuts[1:], strict=False))
    return [p for p in parts if p]


def forms(value: str, cap: int = 512) -> list[tuple[str, ...]]:
    """Every form as words, optional parts left out first.  A level of more than ``cap`` forms is
    given back as it was written."""
    choices: list[list[tuple[str, ...]]] = []
    count = 1
    for part in pieces(value):
        ends = part[0] + part[-1] if len(part) > 1 else ""
        if ends in ("{}", "[]"):
            found = [form for inner in pieces(part[1:-1], at_bar=True) for form in forms(inner, cap)]
            choices.append(([()] if ends == "[]" else []) + found)
        elif "|" in part and part != "|":
            choices.append([(word,) for word in part.split("|") if word])
        else:
            choices.append([(part,)])
        count *= len(choices[-1])
        if count > cap:
            return [tuple(pieces(value))]
    return [sum(way, ()) for way in product(*choices)]


@F.pandas_udf(ArrayType(StringType()))
def _expanded(values: pd.Series) -> pd.Series:
    """Forms of each syntax line; lines that repeat within a batch are expanded once."""
    lines = values.fillna("").map(lambda v: " ".join(v.split()))
    found = {v: [" ".join(form) for form in forms(v)] for v in lines.unique()}
    return lines.map(found)


def alternatives(value: Column) -> Column:
    """``pieces`` at bars, in built-in functions: the trimmed parts between bars outside of balanced
    groups, empty ones dropped.  Lines without a bracket are split at once."""
    mark = "\x00"

    def step(state: Column, c: Column) -> Column:
        top, opened = F.right(state["open"], F.lit(1)), F.length(state["open"]) > 0
        closes = ((c == "}") & (top == "{")) | ((c == "]") & (top == "["))
        now = F.when(c.isin("{", "["), F.concat(state["open"], c)).when(opened & closes, F.left(state["open"], F.length(state["open"]) - 1)).otherwise(state["open"])
        return F.struct(now.alias("open"), F.concat(state["text"], F.when((c == "|") & ~opened, mark).otherwise(c)).alias("text"))

    told = F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("open"), F.lit("").alias("text")), step)["text"]
    parts = F.when(value.rlike(r"[\[{]"), F.split(told, mark)).otherwise(F.split(value, r"\|"))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def expand_syntax(rows: DataFrame, syntax: Column) -> DataFrame:
    """Adds ``pos`` and ``command``: one row per concrete form that is a command without brackets."""
    # rows are dealt over all tasks, as few bytes of them take long; a form is normalised once, before it is a row
    told = spread(rows).select("*", F.posexplode(F.transform(_expanded(syntax), T.normal_command)).alias("pos", "command"))
    return told.where(F.col("command").isNotNull() & ~F.col("command").rlike(r"[{}\[\]]"))
