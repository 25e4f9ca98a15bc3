"""Column functions: everything here returns a ``Column`` and stays in the JVM."""

from ratingml.functions.columns import (
    compact,
    element,
    flag,
    hash_order,
    hash_unit,
    multi_values,
    named,
    number_or_null,
    rating_label,
    spread,
    words,
)

__all__ = [
    "compact",
    "element",
    "flag",
    "hash_order",
    "hash_unit",
    "multi_values",
    "named",
    "number_or_null",
    "rating_label",
    "spread",
    "words",
]
