"""Which share of the rows a filter may keep, by rule, and whether to filter before or after a search."""

from __future__ import annotations

from math import prod

# Shares by operation, the values a field is taken to have, and the share below which the filter comes first.
SHARES = {"gt": 0.5, "gte": 0.5, "lt": 0.5, "lte": 0.5, "geowithin": 0.1, "exists": 0.9, "ne": 0.5}
CARDINALITY = 10
FILTER_FIRST_BELOW = 0.1


def estimate(condition: dict, cardinalities: dict[str, int] | None = None) -> float:
    known = cardinalities or {}
    op = condition["op"]
    if op == "and":
        return prod(estimate(c, known) for c in condition["filters"])
    if op == "or":
        return 1 - prod(1 - estimate(c, known) for c in condition["filters"])
    if op == "not":
        return 1 - estimate(condition["filter"], known)
    if op in ("eq", "in"):
        n = len(condition["values"]) if op == "in" else 1
        return min(1.0, n / known.get(condition["field"], CARDINALITY))
    return SHARES[op]


def strategy(condition: dict, cardinalities: dict[str, int] | None = None) -> str:
    return "filter_first" if estimate(condition, cardinalities) < FILTER_FIRST_BELOW else "filter_last"


def overfetch(share: float, k: int) -> int:
    """How many rows a search takes before the filter."""
    return max(k + 50, int(k * min(20.0, max(1.0, 1 / max(share, 0.01)))))
