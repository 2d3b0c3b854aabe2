"""Math, date and size column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONSTANTS = {"pi": lambda: F.pi(), "e": lambda: F.e(), "tau": lambda: 2 * F.pi()}


def floor_div(a: Column, b: Column) -> Column:
    """Quotient rounded toward minus infinity; null when b is 0."""
    return F.when(b != 0, F.floor(a / b))


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; null when b is 0."""
    return F.when(b != 0, a - b * F.floor(a / b))


def factorial(n: Column) -> Column:
    """Exact up to 20 as bigint arithmetic, beyond that as double; null below 0."""
    big = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(1.0), lambda acc, i: acc * i)
    return F.when(n.between(0, 20), F.factorial(n).cast("double")).when(n > 20, big)


def round_half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


FUNCTIONS = {
    "sqrt": F.sqrt, "log": F.ln, "log10": F.log10, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "floor": F.floor, "ceil": F.ceil, "abs": F.abs, "round": round_half_even, "pow": F.pow,
    "factorial": factorial,
}
OPERATORS = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
    "/": lambda a, b: F.when(b != 0, a / b), "//": floor_div, "%": floor_mod, "^": F.pow,
}


def date_parts(ts: Column, offset_hours: float) -> dict[str, Column]:
    """iso, date, time, weekday and offset text of a UTC timestamp seen at a fixed offset."""
    minutes = int(round(offset_hours * 60))
    sign, rest = ("-" if minutes < 0 else "+"), abs(minutes)
    hh, mm = f"{rest // 60:02d}", f"{rest % 60:02d}"
    local = ts + F.make_interval(mins=F.lit(minutes))
    body = F.when(F.date_format(local, "SSSSSS") == "000000", F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return {
        "iso": F.concat(body, F.lit(f"{sign}{hh}:{mm}")),
        "date": F.date_format(local, "yyyy-MM-dd"),
        "time": F.date_format(local, "HH:mm:ss"),
        "weekday": F.date_format(local, "EEEE"),
        "tz": F.lit(f"{sign}{hh}{mm}"),
    }


def format_bytes(n: Column) -> Column:
    """Base-1024 size with one decimal; `0 B` for sizes up to 0."""
    units = ["B", "KB", "MB", "GB", "TB"]
    chain = F.when(n <= 0, F.lit("0 B"))
    for i, unit in enumerate(units):
        text = F.format_string(f"%.1f {unit}", F.bround(n / float(1024 ** i), 1))
        chain = chain.otherwise(text) if i == len(units) - 1 else chain.when(n < 1024 ** (i + 1), text)
    return chain
