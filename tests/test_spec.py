import pytest

from gristmill.schema import COLUMNS
from gristmill.spec import Measure, QuerySpec, SpecError
from gristmill.suite import ALL


def test_all_documents_parse():
    assert all(QuerySpec.parse(doc, COLUMNS) for doc in ALL.values())


@pytest.mark.parametrize(
    "bad",
    [
        {"select": [{"MEDIAN": "bid_price"}]},
        {"select": ["country", {"COUNT": "*"}]},
        {"select": ["day"], "where": [{"col": "day", "op": "like", "val": "x"}]},
        {"select": ["day"], "where": [{"col": "day", "op": "eq"}]},
        {"select": ["day"], "where": [{"col": "day", "op": "between", "val": [1]}]},
        {"select": ["nothing"]},
        {"select": ["day"], "having": []},
        {"select": ["day"], "limit": "many"},
        {"select": ["country", {"COUNT": "*"}], "group_by": ["country"], "order_by": [{"col": "SUM(bid_price)"}]},
        {"select": [{"SUM": "DISTINCT bid_price"}]},
    ],
)
def test_bad_documents_are_refused(bad):
    with pytest.raises(SpecError):
        QuerySpec.parse(bad, COLUMNS)


def test_names_and_orders():
    spec = QuerySpec.parse({"select": ["day", {"sum": "bid_price"}, {"count": "distinct user_id", "as": "u"}], "group_by": ["day"], "order_by": ["sum(bid_price)", {"col": "COUNT(DISTINCT user_id)", "dir": "DESC"}], "limit": 0})
    assert spec.select == ("day", "SUM(bid_price)", "u") and spec.limit is None
    assert [spec.resolve_order(o) for o in spec.order_by] == ["SUM(bid_price)", "u"]
    assert Measure.parse({"COUNT": "DISTINCT user_id"}).canonical == "COUNT(DISTINCT user_id)"


def test_fingerprints_tell_results_apart():
    doc = {"select": ["day", {"SUM": "bid_price"}], "where": [{"col": "type", "op": "eq", "val": "click"}, {"col": "country", "op": "eq", "val": "US"}], "group_by": ["day"]}
    base = QuerySpec.parse(doc)
    assert base.fingerprint() == QuerySpec.parse(doc | {"where": doc["where"][::-1]}).fingerprint()
    aliased = doc | {"select": ["day", {"SUM": "bid_price", "as": "x"}]}
    ordered = [doc | {"order_by": [{"col": a}, {"col": b}]} for a, b in (("day", "SUM(bid_price)"), ("SUM(bid_price)", "day"))]
    prints = {QuerySpec.parse(d).fingerprint() for d in (doc, aliased, *ordered)} | {base.fingerprint("v2")}
    assert len(prints) == 5


def test_groups_of_another_order_under_a_limit_are_another_query():
    a, b = (QuerySpec.parse({"select": ["country", "type", {"COUNT": "*"}], "group_by": g, "limit": 3}) for g in (["country", "type"], ["type", "country"]))
    assert a.fingerprint() != b.fingerprint()
    a, b = (QuerySpec.parse({"select": ["country", "type", {"COUNT": "*"}], "group_by": g}) for g in (["country", "type"], ["type", "country"]))
    assert a.fingerprint() == b.fingerprint()


def test_having_names_what_is_selected():
    doc = {"select": ["country", {"SUM": "bid_price"}], "group_by": ["country"]}
    spec = QuerySpec.parse({**doc, "having": [{"col": "sum(bid_price)", "op": "gt", "val": 1}]})
    assert spec.having[0].col == "SUM(bid_price)" and spec.fingerprint() != QuerySpec.parse(doc).fingerprint()
    for bad in ({**doc, "having": [{"col": "day", "op": "is_null"}]}, {"select": ["day"], "having": [{"col": "day", "op": "is_null"}]}, {**doc, "where": [{"any": []}]}, {**doc, "where": [{"not": [{"col": "day", "op": "is_null"}]}]}):
        with pytest.raises(SpecError):
            QuerySpec.parse(bad)
