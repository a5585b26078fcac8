"""Column-expression builders (all native Spark expressions, no UDFs)."""

from kpilane.functions.labels import (
    branch_code,
    branch_name,
    iso_date,
    month_factor,
    month_name,
    parse_integer,
    parse_real,
    to_iso_date,
)
from kpilane.functions.scoring import (
    clamp,
    out_of_range,
    pct_to_target,
    rag_status,
    safe_divide,
    weighted_total,
)

__all__ = [
    "branch_code",
    "branch_name",
    "clamp",
    "iso_date",
    "month_factor",
    "month_name",
    "out_of_range",
    "parse_integer",
    "parse_real",
    "pct_to_target",
    "rag_status",
    "safe_divide",
    "to_iso_date",
    "weighted_total",
]
