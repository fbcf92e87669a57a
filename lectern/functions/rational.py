"""Exact numbers from text: fractions, decimals, percentages and powers of ten as num / den with a unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import fold_width

_D = "decimal(38,0)"
MAX_EXPONENT = 12


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


#: A whole number with or without a unit, as most are: it needs none of the steps below.
_PLAIN = r"^([0-9]{1,15}) ?([a-zµω°·/]*)\z"


def parse_rational(raw: Column) -> Column:
    """struct(num, den, unit), or null where the text is no number that can be kept exactly."""
    plain = F.struct(F.regexp_extract(raw, _PLAIN, 1).try_cast(_D).alias("num"), F.lit(1).cast(_D).alias("den"), F.regexp_extract(raw, _PLAIN, 2).alias("unit"))
    return F.when(raw.rlike(_PLAIN), plain).otherwise(_any_rational(raw))


def _any_rational(raw: Column) -> Column:
    trimmed = F.replace(F.lower(F.trim(fold_width(raw))), F.lit("−"), F.lit("-"))
    return _let(trimmed, lambda s: _let(F.trim(F.regexp_replace(s, "%$", "")), lambda t: _with_unit(t, s.endswith("%"))))


def _with_unit(text: Column, percent: Column) -> Column:
    unit = F.regexp_extract(text, "([a-zµω°·/]+)$", 1)
    bare = F.regexp_replace(F.trim(F.regexp_replace(text, "[a-zµω°·/]+$", "")), "[_,]", "")
    hundred = F.when(percent, F.lit(100)).otherwise(F.lit(1)).cast(_D)
    return _let(F.regexp_replace(bare, r"[×*x]10", "e"), lambda s: _number(s, hundred, unit))


_FRACTION = r"^([+-]?[0-9]{1,15})\s*/\s*([0-9]{1,15})$"
_DECIMAL = r"^([+-]?)([0-9]*)(?:\.([0-9]+))?(?:e([+-]?[0-9]{1,4}))?$"


def _number(s: Column, hundred: Column, unit: Column) -> Column:
    num, den = F.regexp_extract(s, _FRACTION, 1).try_cast(_D), F.regexp_extract(s, _FRACTION, 2).try_cast(_D)
    fraction = F.when(den > 0, F.struct(num.alias("num"), (den * hundred).cast(_D).alias("den"), unit.alias("unit")))
    groups = F.struct(*[F.regexp_extract(s, _DECIMAL, k).alias(n) for k, n in enumerate(("sign", "whole", "part", "power"), 1)])

    def decimal(g: Column) -> Column:
        digits = F.concat(g["whole"], g["part"])
        exponent = F.coalesce(g["power"].try_cast("int"), F.lit(0)) - F.length(g["part"])
        mantissa = F.when(F.length(digits).between(1, 15), F.when(g["sign"] == "-", -1).otherwise(1) * digits.try_cast("long")).cast(_D)
        ten = F.get(F.array(*[F.lit(10**k).cast(_D) for k in range(MAX_EXPONENT + 1)]), F.abs(exponent))
        whole = (F.length(g["whole"]) > 0) | (g["power"] == "")
        return F.when(
            mantissa.isNotNull() & ten.isNotNull() & whole,
            F.struct(
                F.when(exponent > 0, mantissa * ten).otherwise(mantissa).cast(_D).alias("num"),
                F.when(exponent < 0, ten * hundred).otherwise(hundred).cast(_D).alias("den"), unit.alias("unit"),
            ),
        )

    return F.when(s.rlike(_FRACTION), fraction).when(s.rlike(_DECIMAL), _let(groups, decimal))


def equal_value(a: Column, b: Column) -> Column:
    """Exact equality by cross-multiplication, units set aside."""
    return a["num"] * b["den"] == b["num"] * a["den"]


def equivalent(a: Column, b: Column) -> Column:
    """The same value; units must agree where both have one."""
    return ((a["unit"] == "") | (b["unit"] == "") | (a["unit"] == b["unit"])) & equal_value(a, b)
