"""Arithmetic, colours, names and predicates on boxes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a colour channel that couldn't be estimated.
SENTINEL = -100


def bound(value: Column, body) -> Column:
    """body(value), with value computed once even if body uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def half_even(x: Column, digits: int = 2) -> Column:
    """Rounds half to even on the decimal value; Python's round looks at the binary one and differs on some ties."""
    return F.bround(x, digits)


def safe_round(x: Column) -> Column:
    """To the nearest whole number, half to even; SENTINEL for null and not-a-number."""
    return F.coalesce(F.rint(F.when(F.isnan(x), None).otherwise(x)).cast("int"), F.lit(SENTINEL))


def parse_color(text: Column) -> Column:
    """array<int> of a "[b, g, r]" string, null if it is none."""
    return F.from_json(text, "array<int>")


def color_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of three channels; infinite if either colour is missing."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, d: s + d)
    return F.coalesce(total / 3, F.lit(float("inf")))


def ratio_distance(r: Column, q: Column, eps: float = 1e-5) -> Column:
    r, q = F.greatest(r, F.lit(eps)), q + F.lit(eps)
    return F.greatest(r / q, q / r)


def ratio_close(a: Column, b: Column, tolerance: float = 0.1) -> Column:
    x = a / F.nullif(b, F.lit(0.0))
    return F.greatest(x, F.lit(1.0) / F.nullif(x, F.lit(0.0))) - 1 <= tolerance


def overlaps(a: str, b: str) -> Column:
    """Open boxes of two aliases share an inner point."""
    c = lambda t, x: F.col(f"{t}.{x}")
    return (c(a, "W_d") < c(b, "W_g")) & (c(a, "W_g") > c(b, "W_d")) & (c(a, "H_b") < c(b, "H_h")) & (c(a, "H_h") > c(b, "H_b"))


def collides(a: str, b: str) -> Column:
    """As overlaps, of closed boxes: touching counts."""
    c = lambda t, x: F.col(f"{t}.{x}")
    return (c(a, "W_d") <= c(b, "W_g")) & (c(a, "W_g") >= c(b, "W_d")) & (c(a, "H_b") <= c(b, "H_h")) & (c(a, "H_h") >= c(b, "H_b"))


def intersection(a: str, b: str) -> Column:
    c = lambda t, x: F.col(f"{t}.{x}")
    wide = F.least(c(a, "W_g"), c(b, "W_g")) - F.greatest(c(a, "W_d"), c(b, "W_d"))
    high = F.least(c(a, "H_h"), c(b, "H_h")) - F.greatest(c(a, "H_b"), c(b, "H_b"))
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def resize_scale(w: Column, h: Column, height: int = 64, width: int = 1024) -> Column:
    """To the height, unless that makes it wider than width."""
    s = F.lit(float(height)) / h
    return F.when((w * s).cast("int") > width, F.lit(float(width)) / w).otherwise(s)


def text_randomised(text: Column, key: Column) -> Column:
    """a-z, A-Z and digits replaced by others of their kind, by draws of the key; other characters stay."""
    byte = lambda i: F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":"), i.cast("string")).cast("binary")), 1, 4), 16, 10).cast("int")

    def one(c: Column, i: Column) -> Column:
        pick = lambda letters, n: F.substring(F.lit(letters), byte(i) % n + 1, F.lit(1))
        return (
            F.when(c.rlike("^[a-z]$"), pick("abcdefghijklmnopqrstuvwxyz", 26))
            .when(c.rlike("^[A-Z]$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 26))
            .when(c.rlike("^[0-9]$"), pick("0123456789", 10))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def renderable(text: Column) -> Column:
    """Every lower-cased character is printable ASCII."""
    return F.lower(text).rlike(r"^[ -~]*$")


def tag(name: Column) -> Column:
    """Last part of a path without outer slashes, lower-cased."""
    return F.lower(F.element_at(F.split(F.regexp_replace(F.trim(name), "^/+|/+$", ""), "/"), -1))


def base_name(file: Column) -> Column:
    """What stands before the last underscore of a file name; null if nothing does."""
    return F.nullif(F.regexp_extract(file, r"^(.+)_[^_]*$", 1), F.lit(""))
