"""Seeded SHA-256 ranks and choices, identical on every engine that has SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def keyed(*parts) -> Column:
    """Hex SHA-256 of the parts joined by colons; strings are literals, columns are cast to text."""
    return F.sha2(F.concat_ws(":", *[F.lit(p) if isinstance(p, (str, int)) else p.cast("string") for p in parts]), 256)


def leading(hexes: Column, digits: int, n) -> Column:
    """The number in the first `digits` hex digits (16 at most), modulo n; unsigned."""
    number = F.conv(F.substring(hexes, 1, digits), 16, 10).cast("decimal(20,0)")
    return F.pmod(number, F.lit(n).cast("decimal(20,0)") if isinstance(n, int) else n.cast("decimal(20,0)")).cast("long")


def bucket(n: int, *parts) -> Column:
    """A number below n from the first eight digits of keyed(parts)."""
    return leading(keyed(*parts), 8, n)


def whole_mod(hexes: Column, n: int) -> Column:
    """The whole digest as one number, modulo n, folded digit by digit."""
    digits = F.transform(F.split(hexes, ""), lambda c: F.conv(c, 16, 10).cast("int"))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda acc, d: ((acc * 16 + d) % n).cast("int"))


def record_id(hexes: Column) -> Column:
    """Eight upper-case digits."""
    return F.upper(F.substring(hexes, 1, 8))


def opaque_id(hexes: Column) -> Column:
    return F.substring(hexes, 1, 12)


def first_bit(hexes: Column) -> Column:
    """Parity of the first byte."""
    return (F.conv(F.substring(hexes, 1, 2), 16, 10).cast("int") % 2).cast("int")


def slug(name: Column, digits: int = 10) -> Column:
    """A file-safe form of a name with the start of its digest."""
    safe = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.concat_ws("-", safe, F.substring(F.sha2(name, 256), 1, digits))


def set_digest(ids: Column) -> Column:
    """Aggregate: SHA-256 of the sorted distinct ids, each on a line of its own."""
    return F.sha2(F.concat(F.array_join(F.array_sort(F.collect_set(ids.cast("string"))), "\n"), F.lit("\n")), 256)


def sequence_digest(position: Column, value: Column) -> Column:
    """Aggregate: SHA-256 of the values in order of position, joined by newlines."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(position.alias("p"), value.alias("v")))), lambda x: x["v"])
    return F.sha2(F.array_join(ordered, "\n"), 256)


def character_index(text: Column, seed: int, n: int) -> Column:
    """(sum of character codes + seed) modulo n."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.pmod(F.aggregate(codes, F.lit(seed), lambda acc, x: acc + x), F.lit(n))
