"""The query contract: small JSON documents, validated and made canonical.

    {"from": table, "select": [column | {FUNC: column | "*" | "DISTINCT column", "as": alias}],
     "where": [{"col", "op", "val"} | {"any": [...]} | {"all": [...]} | {"not": ...}],
     "group_by": [column], "having": [the same, col being a name or an aggregate that is selected],
     "order_by": [{"col", "dir"}], "limit": n}

Unknown operators, functions, columns or keys raise ``SpecError``; nothing is ignored. A missing or
empty select, or "*", means all columns. A limit of 0 means none.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace

OPS = ("eq", "neq", "lt", "lte", "gt", "gte", "between", "in", "is_null", "is_not_null")
FUNCS = ("SUM", "COUNT", "AVG", "MIN", "MAX")
GRAINS = ("minute", "hour", "day", "week")


class SpecError(ValueError):
    """The document is not a query."""


@dataclass(frozen=True)
class Predicate:
    col: str
    op: str
    val: object = None  # a scalar, or a tuple for between and in

    @staticmethod
    def parse(raw: dict) -> Predicate:
        extra = set(raw) - {"col", "op", "val"}
        col, op, val = raw.get("col"), raw.get("op"), raw.get("val")
        if extra or not isinstance(col, str) or op not in OPS:
            raise SpecError(f"not a predicate: {raw}")
        if op in ("is_null", "is_not_null"):
            if val is not None:
                raise SpecError(f"{op} takes no value: {raw}")
        elif op in ("between", "in"):
            if not isinstance(val, (list, tuple)) or (op == "between" and len(val) != 2):
                raise SpecError(f"{op} takes a list of values: {raw}")
            val = tuple(val)
        elif val is None or isinstance(val, (list, tuple, dict)):
            raise SpecError(f"{op} takes one value: {raw}")
        return Predicate(col, op, val)


    @property
    def cols(self) -> tuple[str, ...]:
        return (self.col,)

    def plain(self) -> list:
        return [self.col, self.op, list(self.val) if isinstance(self.val, tuple) else self.val]


@dataclass(frozen=True)
class Group:
    """Conditions of which any, all or (a single one) none must hold."""

    op: str  # any, all or not
    parts: tuple[Predicate | Group, ...]
    col: str = ""  # a group tests no single column
    val: object = None

    @property
    def cols(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(c for p in self.parts for c in p.cols))

    def plain(self) -> list:
        return [self.op, [p.plain() for p in self.parts]]


Condition = Predicate | Group


def condition(raw: dict) -> Condition:
    if not isinstance(raw, dict):
        raise SpecError(f"not a condition: {raw!r}")
    if len(raw) == 1 and (op := next(iter(raw))) in ("any", "all", "not"):
        inner = [raw[op]] if op == "not" else raw[op]
        if not isinstance(inner, (list, tuple)) or not inner:
            raise SpecError(f"{op} takes conditions: {raw}")
        return Group(op, tuple(condition(x) for x in inner))
    return Predicate.parse(raw)


@dataclass(frozen=True)
class Measure:
    func: str
    col: str  # "*" for COUNT(*)
    distinct: bool = False
    alias: str = ""

    @property
    def canonical(self) -> str:
        return f"{self.func}({'DISTINCT ' if self.distinct else ''}{self.col})"

    @property
    def name(self) -> str:
        return self.alias or self.canonical

    @staticmethod
    def parse(raw: dict) -> Measure:
        body = {k: v for k, v in raw.items() if k.lower() != "as"}
        alias = next((v for k, v in raw.items() if k.lower() == "as"), "")
        if len(body) != 1 or not isinstance(alias, str):
            raise SpecError(f"not an aggregate: {raw}")
        ((func, arg),) = body.items()
        func = func.upper()
        if func not in FUNCS or not isinstance(arg, str) or not arg.strip():
            raise SpecError(f"not an aggregate: {raw}")
        words = arg.split()
        distinct = len(words) == 2 and words[0].upper() == "DISTINCT"
        if len(words) > 1 and not distinct or distinct and func != "COUNT" or words[-1] == "*" and (func != "COUNT" or distinct):
            raise SpecError(f"not an aggregate: {raw}")
        return Measure(func, words[-1], distinct, alias)


@dataclass(frozen=True)
class Order:
    col: str
    descending: bool = False


@dataclass(frozen=True)
class QuerySpec:
    table: str = "events"
    columns: tuple[str, ...] = ()
    measures: tuple[Measure, ...] = ()
    select: tuple[str, ...] = ()  # output names in order; empty: all columns
    where: tuple[Condition, ...] = ()
    group_by: tuple[str, ...] = ()
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    having: tuple[Condition, ...] = ()  # columns are output names
    known: tuple[str, ...] | None = field(default=None, compare=False)

    @property
    def aggregates(self) -> bool:
        return bool(self.measures or self.group_by)

    @property
    def grain(self) -> str | None:
        """The finest time column that the query groups by or shows."""
        return next((g for g in GRAINS if g in self.group_by or g in self.columns), None)

    @property
    def dims(self) -> tuple[str, ...]:
        return tuple(c for c in self.group_by if c not in GRAINS)

    def equality(self, col: str):
        """The value that ``col`` is fixed to, or None."""
        found = {p.val for p in self.where if p.col == col and p.op == "eq"}
        return found.pop() if len(found) == 1 else None

    @staticmethod
    def parse(raw: dict, known: tuple[str, ...] | None = None) -> QuerySpec:
        """known: the table's columns, to check names against."""
        extra = set(raw) - {"from", "select", "where", "group_by", "having", "order_by", "limit"}
        if extra:
            raise SpecError(f"unknown keys: {sorted(extra)}")
        columns, measures, select = [], [], []
        items = raw.get("select") or []
        if isinstance(items, (str, dict)):
            items = [items]
        for item in [] if items == ["*"] else items:
            if isinstance(item, str) and item != "*":
                columns.append(item)
                select.append(item)
            elif isinstance(item, dict):
                measures.append(Measure.parse(item))
                select.append(measures[-1].name)
            else:
                raise SpecError(f"not a select item: {item!r}")
        group_by = tuple(raw.get("group_by") or ())
        if len(set(select)) != len(select):
            raise SpecError(f"names given twice: {select}")
        if (measures or group_by) and (stray := set(columns) - set(group_by)):
            raise SpecError(f"neither grouped nor aggregated: {sorted(stray)}")
        if group_by and not select:
            raise SpecError("a grouped query names what it selects")
        order = []
        for o in raw.get("order_by") or ():
            o = {"col": o} if isinstance(o, str) else o
            way = str(o.get("dir") or "asc").lower()
            if set(o) - {"col", "dir"} or way not in ("asc", "desc"):
                raise SpecError(f"not an order: {o}")
            order.append(Order(o["col"], way == "desc"))
        limit = raw.get("limit")
        if limit is not None and (isinstance(limit, bool) or not str(limit).isdigit()):
            raise SpecError(f"not a limit: {limit!r}")
        spec = QuerySpec(raw.get("from", "events"), tuple(columns), tuple(measures), tuple(select), tuple(condition(p) for p in raw.get("where") or ()), group_by, tuple(order), int(limit) or None if limit is not None else None, known=known)
        for o in spec.order_by:
            spec.resolve_order(o)
        if raw.get("having") is not None:
            if not spec.aggregates:
                raise SpecError("having needs groups or aggregates")
            spec = replace(spec, having=tuple(spec._named(condition(p)) for p in raw["having"]))
        if known is not None:
            named = {*columns, *group_by, *(c for p in spec.where for c in p.cols), *(m.col for m in measures if m.col != "*")}
            if missing := named - set(known):
                raise SpecError(f"unknown columns: {sorted(missing)}")
        return spec

    def resolve_order(self, order: Order) -> str:
        """The output name that an order stands for: a name, or an aggregate's canonical text."""
        if order.col in self.select or order.col in self.group_by or not self.aggregates:
            return order.col
        text = "".join(order.col.upper().split())
        for m in self.measures:
            if "".join(m.canonical.upper().split()) == text:
                return m.name
        raise SpecError(f"order by something not selected: {order.col}")

    def _named(self, c: Condition) -> Condition:
        """A condition of having, its columns resolved to output names."""
        if isinstance(c, Group):
            return replace(c, parts=tuple(map(self._named, c.parts)))
        return replace(c, col=self.resolve_order(Order(c.col)))

    def canonical(self) -> dict:
        """Equal for queries of equal results: predicates sorted, everything else as it is."""
        return {
            "from": self.table,
            "select": [[m.canonical, m.name] if (m := next((x for x in self.measures if x.name == s), None)) else s for s in self.select],
            "where": self.where_key(),
            # under a limit, groups break ties in the order they are given
            "group_by": list(self.group_by) if self.limit else sorted(self.group_by),
            "having": sorted((p.plain() for p in set(self.having)), key=repr),
            "order_by": [[self.resolve_order(o), o.descending] for o in self.order_by],
            "limit": self.limit,
        }

    def where_key(self) -> list:
        return sorted((p.plain() for p in set(self.where)), key=repr)

    def fingerprint(self, data_version: str = "") -> str:
        return hashlib.sha256(json.dumps([self.canonical(), data_version], sort_keys=True, default=str).encode()).hexdigest()
