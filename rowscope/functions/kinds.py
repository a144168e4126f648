"""Kinds of values, from Spark types and from VARIANT values, and number texts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Observation kinds in their canonical order.
KINDS = ("null", "bool", "int", "float", "string", "array", "object")

# Kinds of VARIANT type names; others are strings.
_VARIANT = {"VOID": "null", "BOOLEAN": "bool", "BIGINT": "int", "DOUBLE": "float", "FLOAT": "float", "DECIMAL": "float", "ARRAY": "array", "OBJECT": "object"}


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(t, T.DecimalType):
        return "float" if t.scale else "int"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    if isinstance(t, T.VariantType):
        return "variant"
    return "null" if isinstance(t, T.NullType) else "string"


def variant_kind(v: Column) -> Column:
    """Kind of a VARIANT value; SQL NULL (missing) stays NULL.

    An integer too long for BIGINT and a number with a point both parse to DECIMAL; precision tells them apart.
    """
    s = F.schema_of_variant(v)
    names = F.create_map(*[F.lit(x) for pair in _VARIANT.items() for x in pair])
    word = F.try_element_at(names, F.regexp_extract(s, "^[A-Z]+", 0))
    return F.when(v.isNull(), F.lit(None)).when(s.rlike(r"^DECIMAL\((19|[23]\d),0\)"), "int").otherwise(F.coalesce(word, F.lit("string")))


def as_text(c: Column, t: T.DataType) -> Column:
    """A string-kind column as text; times in UTC."""
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), r"\.?0+Z$", "Z")
    return c.cast("string")


def number_text(c: Column, t: T.DataType) -> Column:
    """Shortest text of a number: plain from 1e-4 up to 1e6, else with an exponent of two digits at least."""
    if kind_of(t) == "int":
        return c.cast("string")
    d = c.cast("double")
    usual = (F.abs(d) >= 1e-3) & (F.abs(d) < 1e6)
    return F.when(usual, F.regexp_replace(d.cast("string"), r"\.0$", "")).when(d == 0, "0").otherwise(_let(d.cast("string"), _respelt))


def _let(c: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _respelt(text: Column) -> Column:
    """A number's text, rewritten from its digits and exponent."""
    sign = F.when(text.startswith("-"), "-").otherwise("")
    parts = F.regexp_extract_all(text, F.lit(r"\d+|E-?\d+"), F.lit(0))  # whole, fraction, exponent if any

    def spell(p: Column) -> Column:
        power = F.when(F.size(p) > 2, F.get(p, F.lit(2)).substr(2, 9).cast("int")).otherwise(0)
        digits = F.regexp_replace(F.concat(F.get(p, F.lit(0)), F.get(p, F.lit(1))), "^0+", "")
        zeros = F.length(F.concat(F.get(p, F.lit(0)), F.get(p, F.lit(1)))) - F.length(digits)
        return F.struct(F.regexp_replace(digits, "0+$", "").alias("d"), (power + F.length(F.get(p, F.lit(0))) - 1 - zeros).alias("e"))

    def join(x: Column) -> Column:
        d, e = x["d"], x["e"]
        point = F.when(F.length(d) > 1, F.concat(F.lit("."), d.substr(2, 400))).otherwise("")
        long = F.concat(sign, d.substr(1, 1), point, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
        return F.when((e < -4) | (e >= 6), long).otherwise(F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -e - 1), d))

    odd = F.when(text == "Infinity", "+Inf").when(text == "-Infinity", "-Inf").when(text == "NaN", "NaN")
    return F.coalesce(odd, _let(_let(parts, spell), join))


def number_text_py(x: float) -> str:
    """The same text on the driver."""
    if isinstance(x, int):
        return str(x)
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    r = repr(float(x))
    _, _, e = f"{x:.17e}".partition("e")
    short, _, power = r.partition("e")
    digits = short.lstrip("-").replace(".", "").lstrip("0").rstrip("0") or "0"
    exp = 0 if x == 0 else int(e)
    if x and power == "" and abs(x) >= 1:
        exp = len(short.lstrip("-").split(".")[0]) - 1
    if exp < -4 or exp >= 6:
        return ("-" if x < 0 else "") + digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{'-' if exp < 0 else '+'}{abs(exp):02d}"
    return r[:-2] if r.endswith(".0") else r if power == "" else f"{x:.{len(digits) - 1 - exp}f}"
