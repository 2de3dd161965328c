"""DuckDB SQL of query documents and views, written independently of the Spark side."""

from __future__ import annotations

from .plans.catalog import MVDef, Stored
from .schema import COLUMNS, MONEY
from .spec import Condition, Group, Measure, QuerySpec

#: The adapter view.
EVENTS = """(SELECT ts, CAST(date_trunc('week', ts) AS DATE) AS "week", CAST(ts AS DATE) AS "day", date_trunc('hour', ts) AS "hour",
  strftime(ts, '%Y-%m-%d %H:%M') AS "minute", CASE event_type WHEN 'view' THEN 'impression' WHEN 'signup' THEN 'serve' ELSE event_type END AS type,
  CAST(event_id AS VARCHAR) AS auction_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS advertiser_id, CAST(user_id % 10 AS INTEGER) AS publisher_id,
  CASE WHEN event_type = 'view' THEN value END AS bid_price, user_id, CASE WHEN event_type = 'purchase' THEN value END AS total_price,
  (['US', 'JP', 'DE', 'FR', 'GB'])[CAST(user_id % 5 AS INTEGER) + 1] AS country FROM events)"""


def _name(c: str) -> str:
    return f'"{c}"'


def _value(col: str, v) -> str:
    if col == "ts" and isinstance(v, int):
        return f"make_timestamp({v} * 1000)"
    if isinstance(v, str):
        quoted = "'" + v.replace("'", "''") + "'"
        return f"DATE {quoted}" if col in ("day", "week") else f"TIMESTAMP {quoted}" if col in ("hour", "ts") else quoted
    return str(v)


_SIGNS = {"eq": "=", "neq": "<>", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}


def condition_sql(p: Condition) -> str:
    if isinstance(p, Group):
        parts = [f"({condition_sql(x)})" for x in p.parts]
        return f"NOT {parts[0]}" if p.op == "not" else (" OR " if p.op == "any" else " AND ").join(parts)
    values = p.val if isinstance(p.val, tuple) else (p.val,)
    left = _name(p.col)
    if p.col == "hour" and all(isinstance(v, int) for v in values):
        left = 'extract(hour FROM "hour")'
    own = [_value(p.col, v) for v in values]
    return {"is_null": f"{left} IS NULL", "is_not_null": f"{left} IS NOT NULL", "between": f"{left} BETWEEN {own[0]} AND {own[-1]}", "in": f"{left} IN ({', '.join(own)})"}.get(p.op) or f"{left} {_SIGNS[p.op]} {own[0]}"


def where_sql(spec: QuerySpec) -> str:
    return " WHERE " + " AND ".join(f"({condition_sql(p)})" for p in spec.where) if spec.where else ""


def _sum(col: str, condition: str = "") -> str:
    tail = f" FILTER (WHERE {condition})" if condition else ""
    return f"CAST(sum(CAST({col} AS DECIMAL(18,6))){tail} AS DOUBLE)" if col in MONEY else f"CAST(sum({col}){tail} AS BIGINT)"


def measure_sql(m: Measure) -> str:
    if m.func == "COUNT":
        return f"count({'DISTINCT ' if m.distinct else ''}{m.col})"
    if m.func == "AVG":
        return f"{_sum(m.col)} / nullif(count({m.col}), 0)"
    return _sum(m.col) if m.func == "SUM" else f"{m.func.lower()}({m.col})"


def query_sql(spec: QuerySpec, source: str = EVENTS) -> str:
    by_name = {m.name: m for m in spec.measures}
    names = spec.select or COLUMNS
    items = [f"{measure_sql(by_name[s])} AS {_name(s)}" if s in by_name else _name(s) for s in names]
    sql = f"SELECT {', '.join(items)} FROM {source} AS e{where_sql(spec)}"
    if spec.group_by:
        sql += " GROUP BY " + ", ".join(_name(c) for c in spec.group_by)
    if spec.having:
        sql = f"SELECT * FROM ({sql}) AS h WHERE " + " AND ".join(f"({condition_sql(p)})" for p in spec.having)
    order = [f"{_name(spec.resolve_order(o))} {'DESC' if o.descending else 'ASC'} NULLS LAST" for o in spec.order_by]
    if spec.limit:
        named = {spec.resolve_order(o) for o in spec.order_by}
        order += [f"{_name(c)} ASC NULLS LAST" for c in (spec.group_by or names) if c not in named]
    return sql + (" ORDER BY " + ", ".join(order) if order else "") + (f" LIMIT {spec.limit}" if spec.limit else "")


def stored_sql(s: Stored) -> str:
    condition = f"type = '{s.only}'" if s.only else ""
    tail = f" FILTER (WHERE {condition})" if condition else ""
    if s.func == "SUM":
        return _sum(s.col, condition)
    return {"COUNT": f"count({s.col})", "MIN": f"min({s.col})", "MAX": f"max({s.col})", "DISTINCT": f"count(DISTINCT {s.col})"}[s.func] + tail


def view_sql(mv: MVDef, source: str = EVENTS) -> str:
    tests = ([f"type = '{mv.only}'"] if mv.only else []) + ([f'"{d}" IS NOT NULL' for d in mv.dims] if mv.keyed else [])
    dims = ", ".join(_name(d) for d in mv.dims)
    measures = ", ".join(f"{stored_sql(m)} AS {_name(m.name)}" for m in mv.measures)
    return f"SELECT {dims}, {measures} FROM {source} AS e{' WHERE ' + ' AND '.join(tests) if tests else ''} GROUP BY {dims}"
