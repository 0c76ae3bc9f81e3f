"""Scalar column functions: rounding, names, paths, deterministic draws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(x: Column) -> Column:
    """NaN is the missing marker of array files; everything here takes NULL for it."""
    return F.when(~F.isnan(x), x)


def quantize(x: Column, digits: int) -> Column:
    """Keep about ``digits`` decimals in as few mantissa bits as hold them; half to even."""
    scale = float(2 ** math.ceil(math.log2(10**digits)))
    return F.rint(x * scale) / scale


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    return F.sqrt(dx * dx + dy * dy)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def draw(*keys: Column | str) -> Column:
    """A 32-bit number that depends on the keys alone, the same in any SQL with md5."""
    said = F.concat_ws(":", *[F.lit(k) if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("long")


def session_seed(name: Column) -> Column:
    """The last 32 bits of the name's SHA-512."""
    return F.conv(F.right(F.sha2(name.cast("binary"), 512), F.lit(8)), 16, 10).cast("long")


def first_integer(name: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(name, F.lit(r"(\d+)"), 1), F.lit(1)).cast("long")


def natural_key(name: Column) -> Column:
    """What natural order goes by: runs of digits as numbers, before and apart from the text around them."""
    digits = lambda s: s.rlike(r"^[0-9]")
    part = lambda s: F.struct(F.when(digits(s), 0).otherwise(1).alias("k"), F.when(digits(s), s.cast("decimal(38,0)")).otherwise(F.lit(0)).alias("n"), s.alias("t"))
    return F.transform(F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), part)


def level_of(name: Column) -> Column:
    """What stands before the first slash of a hierarchical name."""
    return F.substring_index(name, "/", 1)


def bank_of(channel: Column, size: int = 32) -> Column:
    return F.floor((channel - 1) / size).cast("long")


def path_parts(path: Column) -> Column:
    """The parts of a path with slashes of either kind."""
    return F.split(path, r"[/\\]")


def shared_prefix(a: Column, b: Column) -> Column:
    """The longest run of leading parts that two part arrays have in common."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.get(a, i - 1) == F.get(b, i - 1)))
    first_off = F.array_position(same, False)
    return F.slice(a, 1, F.when(first_off > 0, first_off - 1).otherwise(n).cast("int"))


def file_stem(path: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.element_at(path_parts(path), -1), r"\.[^.]*$", "")


def parse_number_list(text: Column) -> Column:
    """Numbers of a text such as "[12.5, 13] pix per degree"."""
    inner = F.regexp_extract(text, r"\[([^\]]*)\]", 1)
    return F.transform(F.split(inner, ","), lambda s: F.trim(s).cast("double"))


def significance(p: Column) -> Column:
    """How a p-value is printed: "n.s." from 0.05, else by the decade below which it lies."""
    return F.when(p.isNull(), F.lit("n/a")).when(p >= 0.05, F.lit("n.s.")).when(p >= 0.01, F.lit("p < .05")).when(p >= 0.001, F.lit("p < .01")).otherwise(F.lit("p < .001"))


def border_distance(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Signed distance to the border of an image centred on the origin, negative inside."""
    out = lambda v, size: F.greatest(v - size / 2, -size / 2 - v)
    return F.greatest(out(x, width), out(y, height))
