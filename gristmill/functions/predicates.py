"""Predicates as Spark columns, typed by the column they test."""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, InvalidOperation
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import Condition, Group, SpecError


def literal(value, kind: T.DataType) -> Column:
    """The value as a constant of the column's type, so that filters reach the scan uncast."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.timestamp_millis(F.lit(int(value))).cast(kind)  # epoch milliseconds
    if isinstance(kind, T.StringType):
        return F.lit(str(value))
    return F.lit(value).cast(kind)


_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def whole_test(col: Column, op: str, values: list, kind: T.DataType) -> Column:
    """A test of whole numbers: bounds are rounded towards the numbers that pass, so the column is
    never cast and fractions and numbers beyond its type compare as numbers do."""
    try:
        exact = [Decimal(str(v)) for v in values]
    except InvalidOperation:
        raise SpecError(f"not a number: {values}") from None
    most = 1 << (_BITS[type(kind)] - 1)
    never, always = (F.when(col.isNotNull(), F.lit(x)) for x in (False, True))  # null where the column is

    def number(v: Decimal) -> Column:
        return F.lit(int(v)).cast(kind)

    def below(v: Decimal) -> Column:  # col <= v
        v = v.to_integral_value(ROUND_FLOOR)
        return never if v < -most else always if v >= most else col <= number(v)

    def above(v: Decimal) -> Column:  # col >= v
        v = v.to_integral_value(ROUND_CEILING)
        return never if v >= most else always if v < -most else col >= number(v)

    known = [v for v in exact if v == v.to_integral_value() and -most <= v < most]
    if op in ("eq", "in"):
        return never if not known else col == number(known[0]) if len(known) == 1 else col.isin(*map(number, known))
    if op == "neq":
        return col != number(known[0]) if known else always
    if op == "between":
        return above(exact[0]) & below(exact[1])
    step = Decimal(1)
    v = exact[0]
    if op in ("lt", "gt") and v == v.to_integral_value():
        return below(v - step) if op == "lt" else above(v + step)
    return below(v) if op in ("lt", "lte") else above(v)


def to_column(p: Condition, schema: T.StructType) -> Column:
    if isinstance(p, Group):
        parts = [to_column(x, schema) for x in p.parts]
        return ~parts[0] if p.op == "not" else reduce(or_ if p.op == "any" else and_, parts)
    if p.col not in schema.fieldNames():
        raise SpecError(f"unknown column: {p.col}")
    kind, col = schema[p.col].dataType, F.col(f"`{p.col}`")
    values = p.val if isinstance(p.val, tuple) else () if p.val is None else (p.val,)
    if p.col == "hour" and values and all(isinstance(v, int) and 0 <= v < 24 for v in values):
        col, kind = F.hour(col), T.IntegerType()  # small whole numbers mean the hour of the day
    if type(kind) in _BITS and values and not any(isinstance(v, bool) for v in values):
        return whole_test(col, p.op, list(values), kind)
    own = [literal(v, kind) for v in values]
    if p.op == "is_null":
        return col.isNull()
    if p.op == "is_not_null":
        return col.isNotNull()
    if p.op == "in":
        return col.isin(*own) if own else F.lit(False)
    if p.op == "between":
        return col.between(*own)
    return {"eq": col.__eq__, "neq": col.__ne__, "lt": col.__lt__, "lte": col.__le__, "gt": col.__gt__, "gte": col.__ge__}[p.op](own[0])


def conjunction(where: tuple[Condition, ...], schema: T.StructType) -> Column | None:
    return reduce(and_, (to_column(p, schema) for p in where)) if where else None
