"""Declarative conditions → one boolean Column. SQL's null logic is the three-valued logic the conditions need:
an unknown operand makes the comparison null, and and / or / not follow from there."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewarden.functions.columns import col, lit_list


def _leaf(op: str, c: Column, want: Any) -> Column:
    if op == "exists" or op == "not_null":
        return c.isNotNull() if want is not False else c.isNull()
    simple = {
        "is_null": lambda: c.isNull(), "is_true": lambda: c == F.lit(True), "is_false": lambda: c == F.lit(False),
        "eq": lambda: c == F.lit(want), "neq": lambda: c != F.lit(want), "lt": lambda: c < F.lit(want), "lte": lambda: c <= F.lit(want),
        "gt": lambda: c > F.lit(want), "gte": lambda: c >= F.lit(want),
        "between": lambda: (c >= F.lit(want[0])) & (c <= F.lit(want[1])),
        "in": lambda: c.isin(list(want)), "not_in": lambda: ~c.isin(list(want)),
        "contains": lambda: c.contains(want), "contains_any": lambda: F.arrays_overlap(c, lit_list(want)),
        "contains_all": lambda: F.size(F.array_except(lit_list(want), c)) == 0,
        "starts_with": lambda: c.startswith(want), "ends_with": lambda: c.endswith(want), "matches": lambda: c.rlike(want),
    }
    return simple[op]()


def condition(tree: dict[str, Any]) -> Column:
    """``{"all": […]}``, ``{"any": […]}``, ``{"not": …}`` or ``{"field", "op", "value"}``."""
    if "all" in tree:
        return reduce(lambda a, b: a & b, [condition(x) for x in tree["all"]], F.lit(True))
    if "any" in tree:
        return reduce(lambda a, b: a | b, [condition(x) for x in tree["any"]], F.lit(False))
    if "not" in tree:
        return ~condition(tree["not"])
    return _leaf(tree["op"], col(tree["field"]), tree.get("value"))
