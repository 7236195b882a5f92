"""Searches on small indexes."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.search import IndexMissing, MultiSearch
from tessera.plans.querystring import BadQuery
from tessera.plans.request import DocumentNotFound, Request
from tessera.sources.index import Index


@pytest.fixture(scope="module")
def products(spark):
    rows = spark.createDataFrame([(i, f"Name{i}", 10 * i) for i in range(1, 10)], "id int, name string, age int").coalesce(2)
    return Index("products", frame=rows, id_column="id", text={"name": "standard"}, aggs={"mean_age": {"avg": {"field": "age"}}}, scopes={"young": lambda r: r.filter({"range": {"age": {"lte": 30}}})})


@pytest.fixture(scope="module")
def cities(spark):
    return Index("cities", frame=spark.createDataFrame([(10,), (11,), (12,)], "id int"), id_column="id")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, arrays, empty arrays, accents."""
    rows = [(1, "a", ["red"], 1.0, "Crème brûlée, twice"), (2, None, ["red", "green"], None, "the quick brown fox"), (10, "b", [], 3.0, ""), (3, "b", None, 1.0, None), (4, "c", ["green", "yellow"], 2.0, "quick fox the brown")]
    return Index("odd", frame=spark.createDataFrame(rows, "id int, k string, colors array<string>, x double, t string"), id_column="id", text={"t": "standard"})


def found(r):
    return sorted(h.id for h in r.limit(100))


def test_pages_and_counts(products, cities):
    both = Request(products, cities)
    assert len(both) == 10 and both.count() == 12 and both.total == 12
    assert both.limit(3).count() == 12
    assert products.filter({"term": {"age": 10}}).count() == 1
    assert [h.id for h in products.order({"id": "desc"}).first(3)] == [9, 8, 7]
    assert products.order("id").first().id == 1
    assert products.filter({"term": {"age": 11}}).first() is None
    assert products.exists() and not products.none().exists()
    page = products.order("id").page(2, 3)
    assert [h.id for h in page] == [4, 5, 6] and page.total_pages == 3 and page.current_page == 2
    assert sum(([h.id for h in products.order("id").page(n, 4)] for n in (1, 2, 3)), []) == list(range(1, 10))


def test_hits(products):
    h = products.filter({"term": {"age": 20}}).first()
    assert (h.id, h.name, h.age, h._index, h._id) == (2, "Name2", 20, "products", "2")
    with pytest.raises(AttributeError):
        h.nothing
    assert products.source(False).order("id").first().attributes["id"] == "1"
    assert products.limit(2) == products.limit(2)
    assert products.order("id").response()["hits"]["max_score"] is None
    assert products.query({"match_all": {}}).response()["hits"]["max_score"] == 1.0


def test_find_and_pluck(products):
    assert products.find(3).name == "Name3"
    assert [h.id for h in products.find(3, 1)] == [3, 1]
    with pytest.raises(DocumentNotFound, match="42"):
        products.find(1, 42)
    with pytest.raises(DocumentNotFound):
        products.young().find(9)
    assert products.order("id").pluck("age") == [10 * i for i in range(1, 10)]
    assert products.order("id").limit(2).pluck("_id", "age", "none") == [["1", 10, None], ["2", 20, None]]


def test_scroll(products):
    ids = lambda r, n: [[h.id for h in b] for b in r.scroll_batches(n)]
    assert ids(products.order("id"), 4) == [[1, 2, 3, 4], [5, 6, 7, 8], [9]]
    assert ids(products.order("id").limit(5), 3) == [[1, 2, 3], [4, 5]]
    assert [h.id for h in products.order("id").scroll_hits(2)] == list(range(1, 10))
    assert [h.id for h in products.terminate_after(2).order("id").scroll_hits()] == [1, 2]


def test_missing_index(products, spark):
    gone = Index("gone", root="file:///tmp/tessera-none")
    assert Request(gone).count() == 0 and Request(gone).hits() == []
    assert Request(products, gone).count() == 9
    with pytest.raises(IndexMissing):
        Request(gone).ignore_unavailable(False).count()


def test_null_logic_is_two_valued(odd):
    assert found(odd.filter({"term": {"k": "b"}})) == [3, 10]
    assert found(odd.filter().must_not({"term": {"k": "b"}})) == [1, 2, 4]
    assert found(odd.filter().must_not({"range": {"x": {"gt": 1}}})) == [1, 2, 3]
    assert found(odd.filter({"exists": {"field": "colors"}})) == [1, 2, 4]
    assert found(odd.filter().must_not({"exists": {"field": "colors"}})) == [3, 10]
    assert found(odd.query({"bool": {"should": [{"term": {"k": "a"}}, {"term": {"colors": "green"}}]}})) == [1, 2, 4]
    assert found(odd.filter({"missing": {"field": "x"}})) == [2]
    assert found(odd.filter({"term": {"undeclared": 1}})) == []


def test_arrays_match_by_any_element(odd):
    assert found(odd.filter({"terms": {"colors": ["green"]}})) == [2, 4]
    assert found(odd.filter({"prefix": {"colors": "yel"}})) == [4]


def test_text(odd):
    assert found(odd.query({"match": {"t": "BRÛLÉE"}})) == [1]
    assert found(odd.query({"match_phrase": {"t": "quick brown"}})) == [2]
    assert found(odd.query({"match_phrase": {"t": {"query": "quick brown", "slop": 2}}})) == [2, 4]
    assert found(odd.query({"match": {"t": {"query": "quick brown lazy", "minimum_should_match": "67%"}}})) == [2, 4]
    assert found(odd.query({"match": {"t": {"query": "quikc", "fuzziness": 2}}})) == [2, 4]
    assert found(odd.query({"match": {"t": "..."}})) == []
    assert found(odd.search_string('"brown fox" OR k:c')) == [2, 4]
    assert found(odd.search_string("x:[1 TO 2} -k:a", default_operator="and")) == [3]
    assert found(odd.search_string("qui* AND NOT fox~0")) == []
    for bad in ("(a", "a AND", ")", "AND b", ""):
        with pytest.raises(BadQuery):
            odd.search_string(bad).hits()
    assert [h.id for h in odd.query({"match": {"t": "fox"}})] == [2, 4]  # equal scores: by id


def test_scores(odd, products):
    hits = odd.query({"match": {"t": "brown"}}).explain().hits()
    assert hits[0]._score > 0 and abs(sum(hits[0]._explanation.values()) - hits[0]._score) < 1e-12
    assert products.query({"term": {"age": 10}}).first()._score == 1.0
    assert products.query({"constant_score": {"filter": {"term": {"age": 10}}, "boost": 3}}).first()._score == 3.0
    d = products.query({"dis_max": {"queries": [{"term": {"age": {"value": 10, "boost": 2}}}, {"range": {"age": {"lte": 20}}}], "tie_breaker": 0.5}}).hits()
    assert [(h.id, h._score) for h in d] == [(1, 2.5), (2, 1.0)]
    assert [h.id for h in products.query({"bool": {"must": {"match_all": {}}, "should": {"range": {"age": {"gte": 80}}}}}).min_score(1.5)] == [8, 9]
    assert [h.id for h in products.query({"boosting": {"positive": {"match_all": {}}, "negative": {"term": {"age": 10}}, "negative_boost": 0.1}}).limit(100)][-1] == 1


@pytest.mark.parametrize("spec, n, least", [(2, 5, 2), (-1, 5, 4), ("75%", 4, 3), ("-25%", 4, 3), ("2<75%", 2, 2), ("2<75%", 4, 3), ("3", 2, 2), (None, 3, 0)])
def test_minimum_should_match(spec, n, least):
    from tessera.plans.compiler import least_matches

    assert least_matches(spec, n) == least


def test_order(odd):
    ids = lambda *o: [h.id for h in odd.order(*o)]
    assert ids({"x": "desc"}, "id") == [10, 4, 1, 3, 2]
    assert ids({"x": {"order": "asc", "missing": "_first"}}, "id") == [2, 1, 3, 4, 10]
    assert ids("k", "id") == [1, 3, 10, 4, 2]
    assert ids({"colors": "desc"}) == [4, 1, 2, 3, 10]
    assert ids("_id") == [1, 2, 3, 4, 10]  # numeric ids as numbers
    every = [h.id for h in odd.order({"x": "desc"}, "id")]
    rest = [h.id for h in odd.order({"x": "desc"}, "id").search_after(1.0, 1)]
    assert rest == every[every.index(1) + 1 :]
    assert [h.id for h in odd.order("id").collapse(field="k")] == [1, 2, 3, 4]


def test_aggregations(products, odd):
    assert products.aggs({"a": {"avg": {"field": "age"}}}).aggs()["a"]["value"] == 50.0
    assert products.aggs("mean_age").aggs()["mean_age"]["value"] == 50.0
    tree = odd.aggs({"k": {"terms": {"field": "k"}, "aggs": {"x": {"avg": {"field": "x"}}, "c": {"terms": {"field": "colors"}}}}, "n": {"value_count": {"field": "x"}}}).aggs()
    assert [(x["key"], x["doc_count"], x["x"]["value"]) for x in tree["k"]["buckets"]] == [("b", 2, 2.0), ("a", 1, 1.0), ("c", 1, 2.0)]
    assert tree["k"]["buckets"][1]["c"]["buckets"] == [{"key": "red", "doc_count": 1}] and tree["n"]["value"] == 4
    h = odd.aggs({"h": {"histogram": {"field": "x", "interval": 0.5}}}).aggs()["h"]["buckets"]
    assert [(b["key"], b["doc_count"]) for b in h] == [(1.0, 2), (1.5, 0), (2.0, 1), (2.5, 0), (3.0, 1)]
    assert odd.filter({"term": {"k": "b"}}).aggs({"g": {"global": {}, "aggs": {"n": {"value_count": {"field": "id"}}}}}).aggs()["g"]["n"]["value"] == 5
    assert odd.aggs({"m": {"missing": {"field": "k"}}}).aggs()["m"]["doc_count"] == 1
    pipe = odd.aggs({"h": {"histogram": {"field": "x", "interval": 1}, "aggs": {"r": {"cumulative_sum": {"buckets_path": "_count"}}}}, "m": {"max_bucket": {"buckets_path": "h>_count"}}}).aggs()
    assert [b["r"]["value"] for b in pipe["h"]["buckets"]] == [2, 3, 4] and pipe["m"]["value"] == 2
    top = odd.aggs({"k": {"terms": {"field": "k"}, "aggs": {"t": {"top_hits": {"size": 1, "sort": [{"id": "desc"}]}}}}}).aggs()
    assert [b["t"]["hits"]["hits"][0]["id"] for b in top["k"]["buckets"]] == [10, 1, 4]
    assert odd.aggs({"s": {"stats": {"field": "x"}}}).aggs()["s"]["max"] == 3.0


def test_sibling_and_deep_aggregations(spark):
    rows = [(1, "a", "x", 1.0), (2, "a", None, 3.0), (3, "a", "y", 8.0), (4, "b", None, 2.0), (5, "b", None, 4.0), (6, None, "x", 9.0)]
    i = Index("deep", frame=spark.createDataFrame(rows, "id int, k string, j string, v double"), id_column="id")
    inner = {"one": {"terms": {"field": "j"}, "aggs": {"h": {"histogram": {"field": "v", "interval": 4}, "aggs": {"run": {"cumulative_sum": {"buckets_path": "_count"}}}}}}, "two": {"range": {"field": "v", "ranges": [{"to": 3}, {"from": 3}]}}, "mad": {"median_absolute_deviation": {"field": "v"}}}
    r = i.aggs({"k": {"terms": {"field": "k"}, "aggs": inner}, "low": {"min_bucket": {"buckets_path": "k>mad"}}})
    a, b = r.aggs()["k"]["buckets"]
    assert (a["doc_count"], b["doc_count"], a["mad"]["value"], b["mad"]["value"]) == (3, 2, 2.0, 1.0)
    assert [(x["key"], x["doc_count"], [(h["key"], h["doc_count"], h["run"]["value"]) for h in x["h"]["buckets"]]) for x in a["one"]["buckets"]] == [("x", 1, [(0.0, 1, 1)]), ("y", 1, [(8.0, 1, 1)])]
    assert b["one"]["buckets"] == [] and [x["doc_count"] for x in a["two"]["buckets"]] == [1, 2] and r.aggs()["low"]["value"] == 1.0
    with pytest.raises(ValueError, match="several"):
        r.aggs_frame("k")
    flat = lambda path: sorted((tuple(x) for x in r.aggs_frame("k", path).collect()), key=repr)
    assert flat("one") == [("a", "x", 1), ("a", "y", 1), ("b", None, 0)] and flat("two") == [("a", "*-3", 1), ("a", "3-*", 2), ("b", "*-3", 1), ("b", "3-*", 1)]
    assert flat("one>h") == [("a", "x", 0.0, 1, 1), ("a", "y", 8.0, 1, 1)] or len(flat("one>h")) >= 2
    with pytest.raises(ValueError, match="no inner"):
        r.aggs_frame("k", "three")
    mad = i.aggs({"m": {"median_absolute_deviation": {"field": "v"}}, "f": {"filter": {"term": {"k": "z"}}, "aggs": {"t": {"terms": {"field": "j"}}}}}).aggs()
    assert mad["m"]["value"] == 2.0 and mad["f"] == {"doc_count": 0, "t": {"buckets": []}}
    assert Index("e", frame=spark.createDataFrame([(x, float(2**x)) for x in range(4)], "id int, v double"), id_column="id").aggs({"m": {"median_absolute_deviation": {"field": "v"}}}).aggs()["m"]["value"] == 1.5


def test_scripts_take_any_parameter_and_few_functions(products):
    f = lambda source, **params: found(products.filter({"script": {"script": {"source": source, "params": params}}}))
    for odd in ("O'Neil", "a\\'b", "'; drop", "params.x", "é\n"):
        assert f("concat(name, params.x) = concat('Name3', params.y)", x=odd, y=odd) == [3]
    assert f("age > params.a and params.b and coalesce(params.n, 1) = 1", a=70.5, b=True, n=None) == [8, 9]
    assert f("name = 'java_method(x); y'") == []
    for bad in ("java_method('java.lang.System', 'exit') = 1", "age > 1; select 1", "reflect('a', 'b') = 1", "input_file_name() = 'x'"):
        with pytest.raises(ValueError, match="allowed"):
            f(bad)


def test_sloppy_phrases(spark):
    texts = ["quick brown fox", "brown quick fox", "quick big brown fox", "fox brown quick", "quick a b brown c fox", "go go now", "go now"]
    i = Index("sloppy", frame=spark.createDataFrame(list(enumerate(texts)), "id int, t string"), id_column="id", text={"t": "standard"})
    f = lambda q, slop: found(i.query({"match_phrase": {"t": {"query": q, "slop": slop}}}))
    assert f("quick brown fox", 0) == [0] and f("quick brown fox", 1) == [0, 2] and f("quick brown fox", 2) == [0, 1, 2]
    assert f("quick brown fox", 3) == [0, 1, 2, 4] and f("quick brown fox", 4) == [0, 1, 2, 3, 4] and f("go go", 1) == [5]


def test_stored_analysis(spark, root):
    rows = [(i, f"word{i % 3} the quick {'fox' if i % 2 else 'dog'} {'x' * (i % 5)}", None if i == 7 else f"Tag{i % 4}") for i in range(40)]
    plain = Index("texts", frame=spark.createDataFrame(rows, "id int, t string, u string"), id_column="id", text={"t": "standard", "u": "lowercase_keyword"})
    own = plain.analysed(f"{root}/texts", files=3)
    for q in ({"match": {"t": "fox word1 absent"}}, {"match_phrase": {"t": "quick dog"}}, {"match": {"u": "tag2"}}, {"query_string": {"query": "t:quick AND word2"}}):
        a, b = ([(h.id, h._score) for h in i.query(q).limit(50)] for i in (plain, own))
        assert [x[0] for x in a] == [x[0] for x in b] and all(abs(x[1] - y[1]) < 1e-9 for x, y in zip(a, b, strict=True)) and a
    assert own.query({"match": {"t": "fox"}}).limit(1).frame().columns == plain.query({"match": {"t": "fox"}}).limit(1).frame().columns
    plan = own.filter({"match": {"t": "fox"}}).matching().select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert "__tokens_t" in plan


def test_profile(products):
    told = products.filter({"range": {"age": {"gte": 50}}}).profile().response()["profile"]
    assert "== Physical Plan ==" in told["plan"] and set(told["phases"]) == {"analysis", "optimization", "planning"}
    assert "profile" not in products.limit(1).response()


def test_post_filter_comes_after_aggregations(products):
    r = products.filter({"range": {"age": {"gte": 50}}}).post_filter({"term": {"age": 50}}).aggs({"n": {"value_count": {"field": "age"}}})
    assert r.count() == 1 and r.aggs()["n"]["value"] == 5


def test_fetch(products, odd):
    h = odd.query({"match": {"t": "quick"}}).highlight({"fields": {"t": {}}}).first()
    assert h._highlight["t"] == ["the <em>quick</em> brown fox"] and h.t_highlight == h._highlight["t"][0]
    h = products.script_fields({"double": {"script": {"source": "age * params.f", "params": {"f": 2}}}}).order("id").first()
    assert h.double == 20
    assert set(products.source("na*").first().data) == {"_index", "_id", "_score", "name"}
    assert products.docvalue_fields("age").order("id").first()._fields["age"] == [10]


def test_suggest(products):
    s = products.suggest({"n": {"text": "name", "term": {"field": "name"}}}).suggest()
    assert [(o["text"], o["score"], o["freq"]) for o in s["n"][0]["options"]][:3] == [("name1", 0.75, 1), ("name2", 0.75, 1), ("name3", 0.75, 1)]
    assert products.suggest({"n": {"text": "name3", "term": {"field": "name"}}}).suggest()["n"][0]["options"] == []


def test_multi_search(products):
    m = MultiSearch([products.limit(1), products.young()])
    m.add_query(products.order("id").limit(2))
    assert [len(r) for r in m.responses()] == [1, 3, 2] and all(r.performed for r in m.requests)


def test_knn_and_hybrid(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, [0.7, 0.7], "a"), (4, None, "a")], "id int, v array<float>, k string")
    i = Index("v", frame=rows, id_column="id")
    q = {"field": "v", "query_vector": [1, 0], "k": 2}
    assert [(h.id, round(h._score, 4)) for h in i.knn(q)] == [(1, 1.0), (3, 0.8536)]
    assert [h.id for h in i.knn({**q, "filter": {"term": {"k": "b"}}})] == [2]
    assert [(h.id, round(h._score, 4)) for h in i.query({"term": {"k": "a"}}).knn(q)] == [(1, 2.0), (3, 1.8536), (4, 1.0)]


def test_geo(spark):
    rows = spark.createDataFrame([(1, (52.52, 13.405)), (2, (48.8566, 2.3522)), (3, (0.0, 179.5)), (4, None)], "id int, p struct<lat:double,lon:double>")
    i = Index("geo", frame=rows, id_column="id")
    assert found(i.filter({"geo_distance": {"distance": "900km", "p": {"lat": 52.5, "lon": 13.4}}})) == [1, 2]
    assert found(i.filter({"geo_distance": {"distance": "200km", "p": "0,-179.5"}})) == [3]
    assert found(i.filter({"geo_bounding_box": {"p": {"top_left": "10,179", "bottom_right": "-10,-179"}}})) == [3]
    assert found(i.filter({"geo_polygon": {"p": {"points": ["50,0", "50,5", "45,5", "45,0"]}}})) == [2]
    assert [h.id for h in i.order({"_geo_distance": {"p": "48,2", "order": "asc"}})][:2] == [2, 1]


def test_plans_prune_and_push(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).withColumns({"a": F.col("id") % 7, "b": F.lit("x"), "c": F.lit("y")}).write.parquet(path)
    i = Index("t", frame=spark.read.parquet(path), id_column="id")
    plan = i.filter({"term": {"a": 3}}).source("a").order("id").frame()._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "EqualTo(a,3)" in plan and "struct<id:bigint,a:bigint>" in scan and "TakeOrderedAndProject" in plan


def test_analysed_documents_are_dealt_anew_only_if_they_lie_unevenly(spark, root, monkeypatch):
    rows = [(i, f"word{i} the fox") for i in range(400)]
    frame = spark.createDataFrame(rows, "id int, t string")
    frame.repartition(12).write.parquet(f"{root}/even")
    frame.coalesce(1).write.parquet(f"{root}/single")
    repartition, dealt = type(frame).repartition, []
    monkeypatch.setattr(type(frame), "repartition", lambda self, *a: dealt.append(a) or repartition(self, *a))
    for name, n in (("even", 0), ("single", 1)):
        own = Index(name, frame=lambda name=name: spark.read.parquet(f"{root}/{name}"), id_column="id", text={"t": "standard"}).analysed(f"{root}/own-{name}", files=12)
        assert len(dealt) == n and found(own.query({"match": {"t": "word7 word9"}})) == [7, 9]
        assert found(own.query({"match_phrase": {"t": "Word9 the"}})) == [9]
        assert own.documents().count() == 400 and (name == "even" or dealt[0][1:] == ("id", "t"))
