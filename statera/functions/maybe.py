"""A value or the reason for its absence, as columns.

A reason is a struct whose root fields are carried forward when it is built, so no chain has to be walked. A figure is
a struct of value, currency, rank, extraction, refs and na; a ratio one of value, unit, rank, refs and na. Of value and
na exactly one is not null.
"""

from __future__ import annotations

from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

NA = "struct<reason:string,detail:string,refs:array<string>,root_reason:string,root_detail:string>"
FIGURE = f"struct<value:decimal(38,4),currency:string,rank:int,extraction:string,refs:array<string>,na:{NA}>"
RATIO = f"struct<value:decimal(38,18),unit:string,rank:int,refs:array<string>,na:{NA}>"
NO_REFS = "array<string>"
FIGURE_FIELDS, RATIO_FIELDS = "value currency rank extraction refs na", "value unit rank refs na"


_FIXED: dict[tuple[int, str], Column] = {}


def fixed(sql: str) -> Column:
    """An expression without inputs, made once for a JVM: plans name a few of them hundreds of times."""
    key = (id(SparkContext._jvm), sql)
    if key not in _FIXED:
        _FIXED[key] = F.expr(sql)
    return _FIXED[key]


def no_refs() -> Column:
    return fixed(f"CAST(array() AS {NO_REFS})")


def text(*parts: Column | str) -> Column:
    """Parts joined; a string is literal text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def reason(code: str, detail: Column | str, refs: Column | None = None, cause: Column | None = None) -> Column:
    said = F.lit(detail) if isinstance(detail, str) else detail
    root = (F.lit(code), said) if cause is None else (F.coalesce(cause["root_reason"], F.lit(code)), F.coalesce(cause["root_detail"], said))
    held = no_refs() if refs is None else F.coalesce(refs, no_refs())
    return F.struct(F.lit(code).alias("reason"), said.alias("detail"), held.alias("refs"), root[0].alias("root_reason"), root[1].alias("root_detail"))


def none(kind: str) -> Column:
    return fixed(f"CAST(NULL AS {kind})")


def _struct(names: str, *parts: Column) -> Column:
    """Named without a cast, which would copy every nested field."""
    return F.struct(*[p.alias(n) for n, p in zip(names.split(), parts, strict=True)])


def absent(na: Column, kind: str = FIGURE) -> Column:
    """A figure or ratio of which there is only the reason."""
    if kind == FIGURE:
        return _struct(FIGURE_FIELDS, none("decimal(38,4)"), none("string"), none("int"), none("string"), no_refs(), na)
    return _struct(RATIO_FIELDS, none("decimal(38,18)"), none("string"), none("int"), no_refs(), na)


def figure(value: Column, currency: Column, rank: Column, extraction: Column, refs: Column) -> Column:
    return _struct(FIGURE_FIELDS, value.cast("decimal(38,4)"), currency, rank.cast("int"), extraction, refs, none(NA))


def ratio(value: Column, unit: str, rank: Column, refs: Column) -> Column:
    return _struct(RATIO_FIELDS, value.cast("decimal(38,18)"), F.lit(unit), rank.cast("int"), refs, none(NA))


def known(x: Column) -> Column:
    return x["na"].isNull()


def first_reason(*items: Column) -> Column:
    """The first reason in the order given; null if all are known."""
    return F.coalesce(*[x["na"] for x in items])


def all_known(*items: Column) -> Column:
    return reduce(lambda a, b: a & b, [known(x) for x in items])


def merged_refs(*items: Column) -> Column:
    """References of all items, in order, each once."""
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(x["refs"], no_refs()) for x in items])))


def joined_refs(*items: Column) -> Column:
    return F.concat(*[F.coalesce(x["refs"], no_refs()) for x in items])


def cause_refs(*items: Column) -> Column:
    """References of the reasons among the items, in order."""
    return F.flatten(F.array(*[F.coalesce(x["na"]["refs"], no_refs()) for x in items]))


def missing(name: str, year: Column, *items: Column) -> Column:
    """Missing input for the first reason among the items, with the references of all of them."""
    cause = first_reason(*items)
    return reason("missing_input", text(f"{name} ", year, ": ", cause["detail"]), cause_refs(*items), cause)


def divide(a: Column, b: Column, narrow: str = "decimal(20,4)") -> Column:
    """a / b with 18 decimals where both fit ``narrow``, else with as many as the type leaves; null for b = 0 or overflow."""
    exact = F.try_divide(a.try_cast(narrow), b.try_cast(narrow)).try_cast("decimal(38,18)")
    return F.coalesce(exact, F.try_divide(a, b).try_cast("decimal(38,18)"))
