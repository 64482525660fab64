"""Numbers as text, the way JSON producers in browsers print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_number(value: Column) -> Column:
    """Shortest digits of a double: plain from 1e-6 up to 1e21, else d.ddde+x; no trailing zeros, and -0 is 0."""
    text = F.abs(value).cast("string")
    lead, rest = F.regexp_extract(text, r"^(\d)\.(\d+)E", 1), F.regexp_extract(text, r"^(\d)\.(\d+)E", 2)
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    rest = F.when(rest == "0", "").otherwise(rest)
    digits = F.concat(lead, rest)
    sign = F.when(power < 0, "").otherwise("+")
    scientific = F.concat(lead, F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("e"), sign, power.cast("string"))
    size = power + 1
    whole = F.rpad(digits, size, "0")
    split = F.concat(F.substr(digits, F.lit(1), size), F.lit("."), F.substr(digits, size + 1))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -size), digits)
    moved = F.when((power >= 21) | (power < -6), scientific).when(power < 0, small).when(F.length(digits) <= size, whole).otherwise(split)
    out = F.when(power.isNull(), F.regexp_replace(text, r"\.0$", "")).otherwise(moved)
    return F.when(value < 0, F.concat(F.lit("-"), out)).otherwise(out)
