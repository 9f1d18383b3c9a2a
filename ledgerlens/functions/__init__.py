"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from ledgerlens.functions.parse import (
    na_to_null,
    parse_amount,
    parse_int,
    parse_number,
    parse_timestamp,
)
from ledgerlens.functions.labels import (
    localise_category,
    localise_payment,
    map_lookup,
    weekday_label,
    weekday_label_of,
    weekday_no,
)
from ledgerlens.functions.money import exact_sum, money, trunc_to_long

__all__ = [
    "na_to_null", "parse_amount", "parse_int", "parse_number", "parse_timestamp",
    "localise_category", "localise_payment", "map_lookup", "weekday_label", "weekday_label_of", "weekday_no",
    "exact_sum", "money", "trunc_to_long",
]
