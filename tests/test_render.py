"""Rendered requests, as data: a chain on an empty scope, and the body that it gives."""

import pytest

from tessera.plans.clauses import Bool
from tessera.plans.request import Request
from tessera.sources.index import Index

PRODUCTS, CITIES = Index("products", frame=lambda: None), Index("cities", frame=lambda: None)
a, b = {"term": {"a": 1}}, {"term": {"b": 2}}


def new(*indexes):
    return Request(*(indexes or (PRODUCTS,)))


CASES = [
    (lambda r: r, {}),
    (lambda r: r.query(a).query(b), {"query": {"bool": {"must": [a, b]}}}),
    (lambda r: r.query(a), {"query": a}),
    (lambda r: r.query().should(a).query().must_not(b), {"query": {"bool": {"should": a, "must_not": b}}}),
    (lambda r: r.filter(a), {"query": {"bool": {"filter": a}}}),
    (lambda r: r.filter(a).filter(b), {"query": {"bool": {"filter": [a, b]}}}),
    (lambda r: r.filter().should(a).filter().must_not(b), {"query": {"bool": {"filter": {"bool": {"should": a, "must_not": b}}}}}),
    (lambda r: r.filter().not_(new().filter(a).filter().should(b)), {"query": {"bool": {"filter": {"bool": {"must_not": {"bool": {"must": a, "should": b}}}}}}}),
    (lambda r: r.query(a).filter(b), {"query": {"bool": {"must": a, "filter": b}}}),
    (lambda r: r.query().should(a).filter(b), {"query": {"bool": {"should": a, "filter": b}}}),
    (lambda r: r.query().must_not(a).filter(b), {"query": {"bool": {"must_not": a, "filter": b}}}),
    (lambda r: r.query({"bool": {"must": a, "filter": b}}).filter(a), {"query": {"bool": {"must": a, "filter": [b, a]}}}),
    (lambda r: r.filter(a).none(), {"query": {"match_none": {}}}),
    (lambda r: r.query().should(a).query().minimum_should_match(2), {"query": {"bool": {"should": a, "minimum_should_match": 2}}}),
    (lambda r: r.query().minimum_should_match(2).query().should(a), {"query": {"bool": {"should": a}}}),
    (lambda r: r.order("foo").order("bar", "baz"), {"sort": ["foo", "bar", "baz"]}),
    (lambda r: r.order(foo=42).order(foo=43), {"sort": [{"foo": 42}, {"foo": 43}]}),
    (lambda r: r.order("foo").reorder("bar"), {"sort": ["bar"]}),
    (lambda r: r.order("foo").reorder(None), {}),
    (lambda r: r.limit(10).limit(20), {"size": 20}),
    (lambda r: r.limit(10).limit(None), {}),
    (lambda r: r.limit("5").offset(0), {"size": 5, "from": 0}),
    (lambda r: r.track_scores().track_scores(False), {}),
    (lambda r: r.explain().version().profile(), {"explain": True, "version": True, "profile": True}),
    (lambda r: r.source(excludes="foo").source("bar"), {"_source": {"includes": ["bar"], "excludes": ["foo"]}}),
    (lambda r: r.source("a", "b").source("b", "c"), {"_source": ["a", "b", "c"]}),
    (lambda r: r.source(excludes="foo").source(False), {"_source": False}),
    (lambda r: r.source(excludes="foo").source(False).source(excludes="bar"), {"_source": {"excludes": ["foo", "bar"]}}),
    (lambda r: r.source(excludes="foo").source(False).source(True), {"_source": {"excludes": ["foo"]}}),
    (lambda r: r.stored_fields("foo").stored_fields(False), {"stored_fields": "_none_"}),
    (lambda r: r.stored_fields("foo").stored_fields(False).stored_fields("bar"), {"stored_fields": ["foo", "bar"]}),
    (lambda r: r.docvalue_fields("x").docvalue_fields("y", "x"), {"docvalue_fields": ["x", "y"]}),
    (lambda r: r.indices_boost({"foo": 1.2}).indices_boost({"moo": 1.3}), {"indices_boost": [{"foo": 1.2}, {"moo": 1.3}]}),
    (lambda r: r.indices_boost({"foo": 1.2, "moo": 1}).indices_boost({"foo": 2}), {"indices_boost": [{"moo": 1.0}, {"foo": 2.0}]}),
    (lambda r: r.rescore(a).rescore(b), {"rescore": [a, b]}),
    (lambda r: r.rescore(a).rescore(None), {"rescore": [a]}),
    (lambda r: r.search_after("foo", "bar").search_after("baz"), {"search_after": ["baz"]}),
    (lambda r: r.min_score(1).terminate_after(3).timeout("1s"), {"min_score": 1.0, "terminate_after": 3, "timeout": "1s"}),
    (lambda r: r.aggs({"x": {"avg": {"field": "f"}}}).aggs({"y": {}}), {"aggs": {"x": {"avg": {"field": "f"}}, "y": {}}}),
    (lambda r: r.collapse(field="a").collapse(field="b"), {"collapse": {"field": "b"}}),
    (lambda r: r.post_filter(a).post_filter(b), {"post_filter": {"bool": {"must": [a, b]}}}),
    (lambda r: r.load(only="x"), {}),
]


@pytest.mark.parametrize("chain, body", CASES)
def test_body(chain, body):
    assert chain(new()).render()["body"] == body


def test_beside_the_body():
    assert new().render() == {"index": ["products"], "body": {}}
    assert new().indices("cities").render()["index"] == ["cities", "products"]
    assert new().indices(CITIES, "whatever").render()["index"] == ["cities", "products", "whatever"]
    r = new().request_cache(True)
    assert r.render()["request_cache"] is True
    assert r.request_cache(False).render()["request_cache"] is False
    assert "request_cache" not in r.request_cache(None).render()
    assert new(PRODUCTS, CITIES) == new(CITIES, PRODUCTS)


def test_scope_algebra():
    foo, moo, boo = {"foo": "bar"}, {"moo": "baz"}, {"boo": "baf"}
    one = new().query(foo).filter().should(moo).post_filter().must_not(boo).limit(10)
    two = new().filter(foo).post_filter().should(moo).query().must_not(boo).limit(20)
    before = one.render(), two.render()
    assert one.and_(two).render()["body"] == {
        "query": {"bool": {"must": [foo, {"bool": {"must_not": boo}}], "filter": [{"bool": {"should": moo}}, foo]}},
        "post_filter": {"bool": {"must": [{"bool": {"must_not": boo}}, {"bool": {"should": moo}}]}},
        "size": 10,
    }
    assert one.or_(two).render()["body"] == {
        "query": {"bool": {"should": [foo, {"bool": {"must_not": boo}}], "filter": {"bool": {"should": [{"bool": {"should": moo}}, foo]}}}},
        "post_filter": {"bool": {"should": [{"bool": {"must_not": boo}}, {"bool": {"should": moo}}]}},
        "size": 10,
    }
    assert one.not_(two).render()["body"] == {
        "query": {"bool": {"must": foo, "must_not": {"bool": {"must_not": boo}}, "filter": {"bool": {"should": moo, "must_not": foo}}}},
        "post_filter": {"bool": {"must_not": [boo, {"bool": {"should": moo}}]}},
        "size": 10,
    }
    assert (one.render(), two.render()) == before


def test_merge():
    one, two = new().limit(10).offset(10), new().offset(20).order("foo")
    assert one.merge(two) == new().limit(10).offset(20).order("foo")
    assert two.merge(one) == new().limit(10).offset(10).order("foo")
    assert new().query(a).merge(new().query(b)) == new().query().and_(new().query(a)).query().and_(new().query(b))
    assert new().track_scores().merge(new().explain()).render()["body"] == {"track_scores": True, "explain": True}
    assert new().collapse(field="a").merge(new().collapse(x=1)).render()["body"]["collapse"] == {"field": "a", "x": 1}


def test_only_and_except():
    r = new().limit(10).offset(10)
    assert r.only("limit") == new().limit(10)
    assert r.except_("limit") == new().offset(10)
    assert r.only("limit").render()["index"] == ["products"]
    for wrong in (lambda: r.only(), lambda: r.except_()):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(NameError):
        r.only("nothing")


def test_proxies_need_an_argument():
    for call in (lambda: new().query().must(), lambda: new().filter().or_(), lambda: new().query().must_not()):
        with pytest.raises(ValueError):
            call()


def test_bool_drops_what_is_empty():
    assert Bool.of({"must": a, "ignored": b}).query() == a
    assert Bool.of({}).query() is None
    assert Bool.of([a, None, {}]).query() == a
    assert Bool.of(lambda: a).query() == a
    assert new().query().and_({}).render()["body"] == {}
    assert new().query(a).query().or_({}).render()["body"] == {"query": a}


def test_scopes_nest_and_end():
    cities = Index("cities", frame=lambda: None, scopes={"big": lambda r: r.filter(a), "named": lambda r, n: r.query({"term": {"name": n}}), "both": lambda r: cities.big().named("x")})
    assert cities.big().named("x").render()["body"] == {"query": {"bool": {"must": {"term": {"name": "x"}}, "filter": a}}}
    assert cities.limit(3).both() == cities.limit(3).big().named("x")
    with pytest.raises(RuntimeError):
        with cities.limit(1).as_scope():
            raise RuntimeError
    assert Request.current_scope() is None
