"""Label, calendar and parsing expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kpilane.schemas import MONTH_NAMES, SEASONAL_AMPLITUDE


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def branch_code(tier: Column | str, branch_id: Column | str) -> Column:
    """Upper-cased first three letters of the tier plus the id padded to 3 digits.

    ``format_string`` pads without truncating (``lpad`` would cut 1234 to 123).
    """
    return F.concat(F.upper(F.substring(_c(tier), 1, 3)), F.format_string("%03d", _c(branch_id)))


def branch_name(tier: Column | str, branch_id: Column | str) -> Column:
    return F.format_string("%s Branch %03d", _c(tier), _c(branch_id))


def month_name(month_number: Column | str) -> Column:
    """English month name for 1..12 (locale independent); NULL outside."""
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    m = _c(month_number)
    return F.when(m.between(1, 12), F.element_at(names, m.cast("int")))


def month_factor(month_number: Column | str) -> Column:
    """Seasonality ``1 + 0.06 * sin((m - 1) / 12 * 2 pi)``."""
    m = _c(month_number).cast("double")
    return F.lit(1.0) + F.lit(SEASONAL_AMPLITUDE) * F.sin((m - F.lit(1.0)) / F.lit(12.0) * F.lit(2 * math.pi))


def iso_date(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """``YYYY-MM-DD`` text from integer parts."""
    return F.format_string("%04d-%02d-%02d", _c(year), _c(month), _c(day))


def to_iso_date(text: Column | str) -> Column:
    """ISO ``YYYY-MM-DD`` text (e.g. ``hire_date``) as a DATE; malformed text -> NULL."""
    return F.try_to_date(_c(text), "yyyy-MM-dd")


def parse_integer(text: Column | str) -> Column:
    """CSV integer cell: blank -> NULL, '3.7' -> 3, '-3.7' -> -3, malformed -> error (ANSI)."""
    t = _c(text)
    return F.when(t.isNull() | (t == F.lit("")), F.lit(None).cast("bigint")).otherwise(
        t.cast("double").cast("bigint"))


def parse_real(text: Column | str) -> Column:
    """CSV real cell: blank -> NULL, malformed -> error (ANSI)."""
    t = _c(text)
    return F.when(t.isNull() | (t == F.lit("")), F.lit(None).cast("double")).otherwise(t.cast("double"))
