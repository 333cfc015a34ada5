"""Sizes, ratios and hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_U64 = 2**64 - 1


def size_log10(size: Column) -> Column:
    """0 for 0, else the decade by floating-point logarithm."""
    return F.when(size == 0, 0).otherwise(F.floor(F.log10(size.cast("double"))).cast("int"))


def decade(size: Column) -> Column:
    """Bucket 0 for 0, 1 for 1-9, 2 for 10-99, and so on."""
    return F.when(size == 0, 0).otherwise(F.length(size.cast("string")))


def ratio(part: Column, rest: Column) -> Column:
    """part of part + rest; 0 where both are 0."""
    return F.coalesce(F.try_divide(part, part + rest), F.lit(0.0)).cast("double")


def saturating_sum(value: Column) -> Column:
    return F.least(F.sum(value.cast("decimal(38,0)")), F.lit(str(MAX_U64)).cast("decimal(38,0)"))


def hash_bucket(hex_id: Column, buckets: int) -> Column:
    """From the first byte of a hex id."""
    return F.pmod(F.conv(F.substring(hex_id, 1, 2), 16, 10).cast("int"), F.lit(buckets))


def target_size(size: Column, default: int, factor: int, limit: int) -> Column:
    """default + factor times the integer root of the present size, limit at most."""
    return F.least(F.lit(limit), default + factor * F.floor(F.sqrt(size.cast("double"))).cast("long"))


# The fields of a revision in the order of their bits.
FIELDS = ("mtime", "ctime", "size", "mode", "uid", "gid", "parent", "path")


def known_fields(*fields: Column) -> Column:
    """Names of the fields that are known, in the order of FIELDS."""
    return F.filter(F.array(*(F.when(c.isNotNull(), n) for n, c in zip(FIELDS, fields, strict=True))), lambda x: x.isNotNull())


def format_bytes(size: Column) -> Column:
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in ((10, "KiB"), (20, "MiB"), (30, "GiB"), (40, "TiB")):
        # halves go to the even digit, which format_string alone would round up
        rounded = F.bround((size / float(1 << power)).cast("decimal(38,15)"), 3)
        out = F.when(size >= 1 << power, F.concat(rounded.cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


# Units of sizes, in powers of 1000 and of 1024.
SI = {"": 1, "B": 1, "K": 10**3, "KB": 10**3, "M": 10**6, "MB": 10**6, "G": 10**9, "GB": 10**9, "T": 10**12, "TB": 10**12}
IEC = {"KIB": 2**10, "MIB": 2**20, "GIB": 2**30, "TIB": 2**40}


def parse_size(text: str, units: dict[str, int] | None = None) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]*)\s*", text)
    unit = (SI | IEC if units is None else units).get(m[2].upper()) if m else None
    if unit is None:
        raise ValueError(f"not a size: {text!r}")
    out = int(m[1]) * unit
    if out > MAX_U64:
        raise ValueError(f"size out of range: {text!r}")
    return out


def parse_binary_size(text: str) -> int:
    """Plain units as powers of 1024."""
    return parse_size(text, {"": 1, "B": 1, "K": 2**10, "M": 2**20, "G": 2**30, "T": 2**40})


def parse_size_range(text: str) -> tuple[int, int]:
    """'a..b' or 'a:b' with open ends; 0 is no bound. A single size is both."""
    m = re.split(r"\.\.|:", text)
    if len(m) > 2:
        raise ValueError(f"not a range: {text!r}")
    lo = parse_size(m[0]) if m[0].strip() else 0
    hi = (parse_size(m[1]) if m[1].strip() else 0) if len(m) == 2 else lo
    if hi and lo > hi:
        raise ValueError(f"range ends before it begins: {text!r}")
    return lo, hi
