"""Queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import joins
from tessera.plans.request import Request
from tessera.sources.fields import Crutch, Field, IndexMapping
from tessera.sources.importer import Ids
from tessera.sources.index import Index
from tessera.streaming.feed import delayed_chunks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Table -> id column, analysed text fields.
TABLES = {
    "orders": ("o_orderkey", {}), "lineitem": ("l_orderkey", {}), "customer": ("c_custkey", {}), "supplier": ("s_suppkey", {}), "part": ("p_partkey", {"p_name": "standard"}),
    "nation": ("n_nationkey", {}), "region": ("r_regionkey", {}), "events": ("event_id", {}), "documents": ("doc_id", {"text": "standard"}),
    "embeddings": ("vec_id", {}), "pages": ("page_id", {}), "conversations": ("conv_id", {"text": "standard"}), "benchmark": ("item_id", {"text": "standard"}),
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shared(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder; one of this machine's only in local mode without such a folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


_analysed: dict[tuple, Index] = {}


def index(spark: SparkSession, sf: str, name: str, **more) -> Index:
    """An index over a table; text is analysed once a session and table, then kept with its tokens."""
    key, text = TABLES[name]
    plain = Index(name, frame=lambda: table(spark, sf, name), id_column=key, text=text, **more)
    if not text:
        return plain
    at = (spark.sparkContext.applicationId, sf, name)
    if at not in _analysed:
        _analysed[at] = plain.analysed(shared(spark, f"analysed-{name}"), files=2 * spark.sparkContext.defaultParallelism)
    plain._frame, plain._terms = _analysed[at]._frame, _analysed[at]._terms
    return plain


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def ids(r: Request, *columns: str) -> DataFrame:
    return r.matching().select(*columns)


# -- leaves and boolean algebra ---------------------------------------------------------------------------------


@query("orders_top", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def orders_top(spark, sf):
    r = index(spark, sf, "orders").filter({"term": {"o_orderstatus": "F"}}).filter({"range": {"o_totalprice": {"gt": 100000}}})
    return r.order({"o_totalprice": "desc"}, "o_orderkey").limit(20).frame().select("o_orderkey", "o_totalprice")


@query("term_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def term_filter(spark, sf):
    return ids(index(spark, sf, "orders").filter({"term": {"o_orderstatus": "O"}}), "o_orderkey")


@query("terms_filter", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def terms_filter(spark, sf):
    return ids(index(spark, sf, "orders").filter({"terms": {"o_orderpriority": ["1-URGENT", "2-HIGH"]}}), "o_orderkey")


@query("ids_find", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 2, 3, 7, 32)")
def ids_find(spark, sf):
    return ids(index(spark, sf, "orders").filter({"ids": {"values": [1, 2, 3, 7, 32]}}), "o_orderkey", "o_custkey")


@query("range_numeric", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount > 0.05")
def range_numeric(spark, sf):
    return ids(index(spark, sf, "lineitem").filter({"range": {"l_quantity": {"gte": 10, "lt": 20}}}).filter({"range": {"l_discount": {"gt": 0.05}}}), "l_orderkey", "l_linenumber")


@query("range_date", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'")
def range_date(spark, sf):
    return ids(index(spark, sf, "orders").filter({"range": {"o_orderdate": {"gte": "1996-01-01", "lte": "1996-12-31"}}}), "o_orderkey")


A, B, C = {"term": {"l_returnflag": "R"}}, {"range": {"l_quantity": {"gt": 25}}}, {"range": {"l_tax": {"lte": 0.02}}}


@query("bool_must_should_not", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 25 OR l_tax <= 0.02) AND NOT coalesce(l_returnflag = 'R', false)")
def bool_must_should_not(spark, sf):
    return ids(index(spark, sf, "lineitem").query().should(B).query().should(C).query().must_not(A), "l_orderkey", "l_linenumber")


@query("bool_msm2", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) + (CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) + (CASE WHEN l_tax <= 0.02 THEN 1 ELSE 0 END) >= 2")
def bool_msm2(spark, sf):
    return ids(index(spark, sf, "lineitem").query({"bool": {"should": [A, B, C], "minimum_should_match": 2}}), "l_orderkey", "l_linenumber")


@query("should_with_filter_optional", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25")
def should_with_filter_optional(spark, sf):
    return ids(index(spark, sf, "lineitem").query().should(A).filter(B), "l_orderkey", "l_linenumber")


F1, F2 = {"term": {"o_orderstatus": "F"}}, {"range": {"o_totalprice": {"gte": 150000}}}


@query("scope_and", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 150000")
def scope_and(spark, sf):
    o = index(spark, sf, "orders")
    return ids(o.filter(F1).and_(o.filter(F2)), "o_orderkey")


@query("scope_or", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_totalprice >= 150000")
def scope_or(spark, sf):
    o = index(spark, sf, "orders")
    return ids(o.filter(F1).or_(o.filter(F2)), "o_orderkey")


@query("scope_not", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT (o_totalprice >= 150000)")
def scope_not(spark, sf):
    o = index(spark, sf, "orders")
    return ids(o.filter(F1).not_(o.filter(F2)), "o_orderkey")


@query("scope_merge", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 150000 ORDER BY o_orderkey LIMIT 7 OFFSET 3")
def scope_merge(spark, sf):
    o = index(spark, sf, "orders")
    return o.filter(F1).limit(7).merge(o.filter(F2).offset(3).order("o_orderkey")).frame().select("o_orderkey")


@query("named_scope", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 150000")
def named_scope(spark, sf):
    o = index(spark, sf, "orders", scopes={"pending": lambda r: r.filter({"term": {"o_orderstatus": "P"}}), "above": lambda r, x: r.filter({"range": {"o_totalprice": {"gte": x}}})})
    return ids(o.pending().above(150000), "o_orderkey")


@query("prefix_wildcard_regexp", "SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1') OR p_type LIKE '%MALL' OR regexp_full_match(p_brand, 'Brand#[45]5')")
def prefix_wildcard_regexp(spark, sf):
    return ids(index(spark, sf, "part").query({"bool": {"should": [{"prefix": {"p_brand": "Brand#1"}}, {"wildcard": {"p_type": "*MALL"}}, {"regexp": {"p_brand": "Brand#[45]5"}}]}}), "p_partkey")


@query("fuzzy", "SELECT e.event_id FROM events e WHERE levenshtein(event_type, 'clik') <= 1")
def fuzzy(spark, sf):
    return ids(index(spark, sf, "events").query({"fuzzy": {"event_type": {"value": "clik", "fuzziness": 1}}}), "event_id")


LEFT_LABELS = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def labelled(spark, sf) -> Index:
    rows = lambda: table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return Index("labelled", frame=rows, id_column="doc_id")


@query("exists_missing", f"SELECT d.doc_id FROM {LEFT_LABELS} WHERE l.quality IS NULL AND NOT coalesce(d.lang = 'fr', false)")
def exists_missing(spark, sf):
    return ids(labelled(spark, sf).filter().must_not({"exists": {"field": "quality"}}).filter().must_not({"term": {"lang": "fr"}}), "doc_id")


@query("must_not_null", f"SELECT d.doc_id FROM {LEFT_LABELS} WHERE NOT coalesce(l.quality = 1, false)")
def must_not_null(spark, sf):
    return ids(labelled(spark, sf).filter().must_not({"term": {"quality": 1}}), "doc_id")


@query("script_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * l_discount > 4000")
def script_filter(spark, sf):
    return ids(index(spark, sf, "lineitem").filter({"script": {"script": {"source": "l_extendedprice * l_discount > params.x", "params": {"x": 4000}}}}), "l_orderkey", "l_linenumber")


# -- full text --------------------------------------------------------------------------------------------------

TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
TOKENS = f"tok AS (SELECT doc_id, {TOK} AS t FROM documents)"


@query("match_or", f"WITH {TOKENS} SELECT doc_id FROM tok WHERE list_has_any(t, ['license', 'clown', 'idiot'])")
def match_or(spark, sf):
    return ids(index(spark, sf, "documents").query({"match": {"text": "License clown, IDIOT"}}), "doc_id")


@query("match_and", f"WITH {TOKENS} SELECT doc_id FROM tok WHERE list_has_all(t, ['the', 'license'])")
def match_and(spark, sf):
    return ids(index(spark, sf, "documents").query({"match": {"text": {"query": "the license", "operator": "and"}}}), "doc_id")


@query("match_phrase", f"WITH {TOKENS} SELECT doc_id FROM tok WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' apache license ')")
def match_phrase(spark, sf):
    return ids(index(spark, sf, "documents").query({"match_phrase": {"text": "Apache License"}}), "doc_id")


@query("multi_match", "WITH tok AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+') AS t, p_brand FROM part) SELECT p_partkey FROM tok WHERE list_contains(t, 'widget') OR p_brand = 'widget'")
def multi_match(spark, sf):
    return ids(index(spark, sf, "part").query({"multi_match": {"query": "widget", "fields": ["p_name^2", "p_brand"]}}), "p_partkey")


@query("query_string", f"WITH {TOKENS} SELECT doc_id FROM tok JOIN documents USING (doc_id) WHERE (list_contains(t, 'license') OR list_contains(t, 'clown')) AND NOT list_contains(t, 'apache') AND lang = 'en'")
def query_string(spark, sf):
    return ids(index(spark, sf, "documents").search_string("(license OR clown) AND NOT apache AND lang:en", fields=["text"]), "doc_id")


def bm25_sql(terms: list[str]) -> str:
    parts = " + ".join(f"(CASE WHEN f{i} > 0 THEN ln(1 + (s.n - s.d{i} + 0.5) / (s.d{i} + 0.5)) * f{i} / (f{i} + 1.2 * (1 - 0.75 + 0.75 * len / s.mean)) ELSE 0 END)" for i in range(len(terms)))
    tf = ", ".join(f"len(list_filter(t, lambda w: w = '{x}')) AS f{i}" for i, x in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(terms)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"WITH {TOKENS}, tf AS (SELECT doc_id, len(t) AS len, {tf} FROM tok), s AS (SELECT count(*) AS n, avg(len) AS mean, {df} FROM tf), scored AS (SELECT doc_id, {parts} AS score FROM tf, s WHERE {some})"


@query("bm25_topk", bm25_sql(["license", "version"]) + " SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 10")
def bm25_topk(spark, sf):
    r = index(spark, sf, "documents").query({"match": {"text": "license version"}}).limit(10)
    return r.frame().select("doc_id", F.round("_score", 6).alias("score"))


@query("min_score", bm25_sql(["license", "version"]) + " SELECT doc_id FROM scored WHERE score >= 2.0")
def min_score(spark, sf):
    return ids(index(spark, sf, "documents").query({"match": {"text": "license version"}}).min_score(2.0), "doc_id")


@query("rescore_window", "WITH a AS (SELECT doc_id, 1.0 AS s, row_number() OVER (ORDER BY doc_id) AS r, text FROM documents WHERE lang = 'en') SELECT doc_id, CASE WHEN r <= 50 AND n_chars > 2000 THEN 3.0 ELSE 1.0 END AS score FROM a JOIN documents USING (doc_id) ORDER BY (r <= 50) DESC, score DESC, doc_id LIMIT 15")
def rescore_window(spark, sf):
    r = index(spark, sf, "documents").query({"term": {"lang": "en"}}).rescore({"window_size": 50, "query": {"rescore_query": {"range": {"n_chars": {"gt": 2000}}}, "rescore_query_weight": 2}})
    return r.limit(15).frame().select("doc_id", F.col("_score").alias("score"))


@query("indices_boost", "SELECT * FROM (SELECT 'customer' AS idx, c_custkey AS id, 1.0 AS score FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'supplier', s_suppkey, 2.5 FROM supplier WHERE s_nationkey = 3) ORDER BY score DESC, idx, id LIMIT 12")
def indices_boost(spark, sf):
    c = Index("customer", frame=lambda: table(spark, sf, "customer").selectExpr("c_custkey id", "c_nationkey nation"), id_column="id")
    s = Index("supplier", frame=lambda: table(spark, sf, "supplier").selectExpr("s_suppkey id", "s_nationkey nation"), id_column="id")
    r = Request(c, s).query({"term": {"nation": 3}}).indices_boost({"supplier": 2.5}).limit(12)
    return r.frame().select(F.col("_index").alias("idx"), "id", F.col("_score").alias("score"))


@query("function_score", "SELECT o_orderkey, round(1.0 * log10(o_totalprice * 0.1 + 1), 6) AS score FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def function_score(spark, sf):
    q = {"function_score": {"query": {"term": {"o_orderstatus": "P"}}, "field_value_factor": {"field": "o_totalprice", "factor": 0.1, "modifier": "log1p"}}}
    return index(spark, sf, "orders").query(q).limit(10).frame().select("o_orderkey", F.round("_score", 6).alias("score"))


# -- order and pages --------------------------------------------------------------------------------------------


@query("sort_multi_nulls", f"SELECT d.doc_id, l.quality FROM {LEFT_LABELS} ORDER BY l.quality DESC NULLS LAST, d.lang, d.doc_id LIMIT 600")
def sort_multi_nulls(spark, sf):
    return labelled(spark, sf).order({"quality": "desc"}, "lang", "doc_id").limit(600).frame().select("doc_id", "quality")


@query("page_3", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 50")
def page_3(spark, sf):
    return index(spark, sf, "orders").filter({"term": {"o_orderstatus": "O"}}).order("o_orderdate", "o_orderkey").page(3, 25).frame().select("o_orderkey")


@query("search_after", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 30 OR (l_quantity = 30 AND l_orderkey > 500) ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 40")
def search_after(spark, sf):
    return index(spark, sf, "lineitem").order({"l_quantity": "desc"}, "l_orderkey", "l_linenumber").search_after(30.0, 500).limit(40).frame().select("l_orderkey", "l_linenumber")


@query("collapse_top1", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def collapse_top1(spark, sf):
    r = index(spark, sf, "orders").order({"o_totalprice": "desc"}, "o_orderkey").collapse({"field": "o_custkey"})
    return r.search.page(everything=True).select("o_custkey", "o_orderkey")


@query("terminate_after", "SELECT * FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100)")
def terminate_after(spark, sf):
    return ids(index(spark, sf, "orders").filter(F1).terminate_after(100), "o_orderkey")


@query("count_only", "SELECT count(*) AS n FROM orders WHERE o_totalprice >= 150000")
def count_only(spark, sf):
    return index(spark, sf, "orders").filter(F2).matching().agg(F.count("*").alias("n"))


# -- aggregations -----------------------------------------------------------------------------------------------


def agg(spark, sf, name: str, spec: dict, request: Callable = lambda r: r) -> DataFrame:
    return request(index(spark, sf, name).all()).aggs({"a": spec}).aggs_frame("a")


@query("agg_avg", "SELECT round(avg(o_totalprice), 4) AS a FROM orders WHERE o_orderstatus = 'F'")
def agg_avg(spark, sf):
    return agg(spark, sf, "orders", {"avg": {"field": "o_totalprice"}}, lambda r: r.filter(F1)).select(F.round("a", 4).alias("a"))


@query("agg_stats", "SELECT count(value) AS n, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean, round(sum(value), 2) AS total, round(stddev_pop(value), 4) AS dev FROM events")
def agg_stats(spark, sf):
    d = agg(spark, sf, "events", {"extended_stats": {"field": "value"}})
    return d.select(F.col("`a.count`").alias("n"), F.col("`a.min`").alias("low"), F.col("`a.max`").alias("high"), F.round("`a.avg`", 4).alias("mean"), F.round("`a.sum`", 2).alias("total"), F.round("`a.std_deviation`", 4).alias("dev"))


@query("agg_terms", "SELECT event_type AS key, count(*) AS doc_count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def agg_terms(spark, sf):
    return agg(spark, sf, "events", {"terms": {"field": "event_type", "size": 3}})


@query("agg_terms_sub_avg", "SELECT o_orderpriority AS key, count(*) AS doc_count, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def agg_terms_sub_avg(spark, sf):
    return agg(spark, sf, "orders", {"terms": {"field": "o_orderpriority"}, "aggs": {"mean": {"avg": {"field": "o_totalprice"}}}}).withColumn("mean", F.round("mean", 4))


@query("agg_terms_terms", "SELECT l_returnflag AS key, l_linestatus AS status, count(*) AS doc_count, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1, 2")
def agg_terms_terms(spark, sf):
    spec = {"terms": {"field": "l_returnflag"}, "aggs": {"status": {"terms": {"field": "l_linestatus"}, "aggs": {"quantity": {"sum": {"field": "l_quantity"}}}}}}
    return agg(spark, sf, "lineitem", spec).withColumn("quantity", F.round("quantity", 2))


@query("agg_cardinality", "SELECT count(DISTINCT o_custkey) AS a FROM orders")
def agg_cardinality(spark, sf):
    return agg(spark, sf, "orders", {"cardinality": {"field": "o_custkey"}})


@query("agg_percentiles", "SELECT round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders")
def agg_percentiles(spark, sf):
    d = agg(spark, sf, "orders", {"percentiles": {"field": "o_totalprice", "percents": [25, 50, 95]}})
    return d.select(*[F.round(f"`a.{p}`", 4).alias(f"p{p}") for p in (25, 50, 95)])


@query("agg_percentile_ranks", "SELECT round(100.0 * count(*) FILTER (value <= 50) / count(value), 6) AS r50 FROM events")
def agg_percentile_ranks(spark, sf):
    return agg(spark, sf, "events", {"percentile_ranks": {"field": "value", "values": [50]}}).select(F.round("`a.50`", 6).alias("r50"))


@query("agg_histogram", "WITH h AS (SELECT floor(o_totalprice / 50000) * 50000 AS key, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT a + i * 50000 AS key FROM (SELECT min(key) AS a, max(key) AS b FROM h), unnest(range(0, CAST((b - a) / 50000 AS BIGINT) + 1)) AS t(i)) SELECT g.key, coalesce(n, 0) AS doc_count FROM g LEFT JOIN h ON g.key = h.key")
def agg_histogram(spark, sf):
    return agg(spark, sf, "orders", {"histogram": {"field": "o_totalprice", "interval": 50000}})


@query("agg_date_histogram_gapfill", "WITH h AS (SELECT date_trunc('day', ts) AS key, count(*) AS n FROM events WHERE event_type = 'error' AND value > 90 GROUP BY 1), g AS (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS key FROM (SELECT min(key) AS a, max(key) AS b FROM h)) SELECT strftime(g.key, '%Y-%m-%d') AS day, coalesce(n, 0) AS doc_count FROM g LEFT JOIN h ON g.key = h.key")
def agg_date_histogram_gapfill(spark, sf):
    d = agg(spark, sf, "events", {"date_histogram": {"field": "ts", "calendar_interval": "day"}}, lambda r: r.filter({"term": {"event_type": "error"}}).filter({"range": {"value": {"gt": 90}}}))
    return d.select(F.date_format("key", "yyyy-MM-dd").alias("day"), "doc_count")


@query("agg_filters", "SELECT 'cheap' AS key, count(*) FILTER (o_totalprice < 50000) AS doc_count FROM orders UNION ALL SELECT 'urgent', count(*) FILTER (o_orderpriority = '1-URGENT') FROM orders")
def agg_filters(spark, sf):
    return agg(spark, sf, "orders", {"filters": {"filters": {"cheap": {"range": {"o_totalprice": {"lt": 50000}}}, "urgent": {"term": {"o_orderpriority": "1-URGENT"}}}}})


@query("agg_range", "SELECT 'low' AS key, count(*) FILTER (value < 20) AS doc_count FROM events UNION ALL SELECT 'mid', count(*) FILTER (value >= 20 AND value < 60) FROM events UNION ALL SELECT 'high', count(*) FILTER (value >= 60) FROM events")
def agg_range(spark, sf):
    return agg(spark, sf, "events", {"range": {"field": "value", "ranges": [{"key": "low", "to": 20}, {"key": "mid", "from": 20, "to": 60}, {"key": "high", "from": 60}]}})


@query("agg_missing", f"SELECT count(*) FILTER (l.quality IS NULL) AS doc_count FROM {LEFT_LABELS}")
def agg_missing(spark, sf):
    return labelled(spark, sf).aggs({"a": {"missing": {"field": "quality"}}}).aggs_frame("a").select("doc_count")


@query("agg_global", "SELECT count(*) AS doc_count, round(avg(o_totalprice), 4) AS mean FROM orders")
def agg_global(spark, sf):
    return agg(spark, sf, "orders", {"global": {}, "aggs": {"mean": {"avg": {"field": "o_totalprice"}}}}, lambda r: r.filter(F1)).withColumn("mean", F.round("mean", 4))


@query("agg_top_hits", "SELECT key, hit_rank, o_orderkey FROM (SELECT o_orderstatus AS key, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS hit_rank FROM orders) WHERE hit_rank <= 2")
def agg_top_hits(spark, sf):
    spec = {"terms": {"field": "o_orderstatus"}, "aggs": {"best": {"top_hits": {"size": 2, "sort": [{"o_totalprice": "desc"}]}}}}
    return agg(spark, sf, "orders", spec).select("key", "hit_rank", "o_orderkey")


@query("agg_composite", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS doc_count FROM lineitem GROUP BY 1, 2 HAVING (l_returnflag, l_linestatus) > ('A', 'F') ORDER BY 1, 2 LIMIT 3")
def agg_composite(spark, sf):
    return agg(spark, sf, "lineitem", {"composite": {"size": 3, "sources": [{"flag": {"terms": {"field": "l_returnflag"}}}, {"status": {"terms": {"field": "l_linestatus"}}}], "after": {"flag": "A", "status": "F"}}})


DAYS = "SELECT date_trunc('day', ts) AS k, count(*) AS doc_count, sum(value) AS v FROM events GROUP BY 1"


@query("agg_cumulative_sum", f"SELECT strftime(k, '%Y-%m-%d') AS day, doc_count, round(sum(v) OVER (ORDER BY k), 4) AS running, doc_count - lag(doc_count) OVER (ORDER BY k) AS change FROM ({DAYS})")
def agg_cumulative_sum(spark, sf):
    spec = {"date_histogram": {"field": "ts", "calendar_interval": "day"}, "aggs": {"v": {"sum": {"field": "value"}}, "running": {"cumulative_sum": {"buckets_path": "v"}}, "change": {"derivative": {"buckets_path": "_count"}}}}
    return agg(spark, sf, "events", spec).select(F.date_format("key", "yyyy-MM-dd").alias("day"), "doc_count", F.round("running", 4).alias("running"), "change")


@query("post_filter_vs_aggs", "SELECT (SELECT count(*) FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus = 'F') AS hits, key, doc_count FROM (SELECT o_orderstatus AS key, count(*) AS doc_count FROM orders WHERE o_totalprice >= 150000 GROUP BY 1)")
def post_filter_vs_aggs(spark, sf):
    r = index(spark, sf, "orders").filter(F2).post_filter(F1).aggs({"a": {"terms": {"field": "o_orderstatus"}}})
    return r.matching().agg(F.count("*").alias("hits")).join(F.broadcast(r.aggs_frame("a")), F.lit(True)).select("hits", "key", "doc_count")


@query("agg_siblings", "SELECT o_orderstatus AS key, o_orderpriority AS priority, count(*) AS doc_count, round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1, 2")
def agg_siblings(spark, sf):
    inner = {"priority": {"terms": {"field": "o_orderpriority"}, "aggs": {"top": {"max": {"field": "o_totalprice"}}}}, "price": {"range": {"field": "o_totalprice", "ranges": [{"to": 100000}, {"from": 100000}]}}}
    r = index(spark, sf, "orders").aggs({"a": {"terms": {"field": "o_orderstatus"}, "aggs": inner}})
    return r.aggs_frame("a", "priority").withColumn("top", F.round("top", 2))


@query("agg_siblings_range", "SELECT s.key, p.price, count(o_orderkey) AS doc_count FROM (SELECT DISTINCT o_orderstatus AS key FROM orders) s CROSS JOIN (VALUES ('*-100000'), ('100000-*')) p(price) LEFT JOIN orders ON o_orderstatus = s.key AND (CASE WHEN o_totalprice < 100000 THEN '*-100000' ELSE '100000-*' END) = p.price GROUP BY 1, 2")
def agg_siblings_range(spark, sf):
    inner = {"priority": {"terms": {"field": "o_orderpriority"}}, "price": {"range": {"field": "o_totalprice", "ranges": [{"to": 100000}, {"from": 100000}]}}}
    return index(spark, sf, "orders").aggs({"a": {"terms": {"field": "o_orderstatus"}, "aggs": inner}}).aggs_frame("a", "price")


GAPS = "SELECT o_orderkey, o_orderstatus AS k, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 3 > 0 THEN o_orderpriority END AS j, o_totalprice AS v FROM orders"


def with_gaps(spark, sf) -> Index:
    rows = lambda: table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderstatus k", "case when o_orderstatus <> 'P' and o_orderkey % 3 > 0 then o_orderpriority end j", "o_totalprice v")
    return Index("gaps", frame=rows, id_column="o_orderkey")


@query("agg_terms_null_inner", f"WITH g AS ({GAPS}), o AS (SELECT k, count(*) AS n FROM g GROUP BY 1), i AS (SELECT k, j, count(*) AS c FROM g WHERE j IS NOT NULL GROUP BY 1, 2) SELECT o.k AS key, o.n AS outer_count, i.j, coalesce(i.c, 0) AS doc_count FROM o LEFT JOIN i ON o.k = i.k")
def agg_terms_null_inner(spark, sf):
    r = with_gaps(spark, sf).aggs({"a": {"terms": {"field": "k"}, "aggs": {"j": {"terms": {"field": "j"}}}}})
    outer = r.aggs_frame("a", "").select("key", F.col("doc_count").alias("outer_count"))
    return r.aggs_frame("a").join(outer, "key").select("key", "outer_count", "j", "doc_count")


@query("agg_mad", "WITH m AS (SELECT o_orderstatus AS key, median(o_totalprice) AS mid FROM orders GROUP BY 1) SELECT key, count(*) AS doc_count, round(median(abs(o_totalprice - mid)), 4) AS mad FROM orders JOIN m ON o_orderstatus = key GROUP BY 1")
def agg_mad(spark, sf):
    d = agg(spark, sf, "orders", {"terms": {"field": "o_orderstatus"}, "aggs": {"mad": {"median_absolute_deviation": {"field": "o_totalprice"}}}})
    return d.withColumn("mad", F.round("mad", 4))


@query("agg_moving_fn", f"SELECT strftime(k, '%Y-%m-%d') AS day, doc_count, round(avg(v) OVER (ORDER BY k ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS mean, round(max(v) OVER (ORDER BY k ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS top FROM ({DAYS})")
def agg_moving_fn(spark, sf):
    inner = {"v": {"sum": {"field": "value"}}, "mean": {"moving_fn": {"buckets_path": "v", "window": 3, "script": "MovingFunctions.unweightedAvg(values)"}}, "top": {"moving_fn": {"buckets_path": "v", "window": 3, "script": "MovingFunctions.max(values)"}}}
    d = agg(spark, sf, "events", {"date_histogram": {"field": "ts", "calendar_interval": "day"}, "aggs": inner})
    return d.select(F.date_format("key", "yyyy-MM-dd").alias("day"), "doc_count", F.round("mean", 4).alias("mean"), F.round("top", 4).alias("top"))


@query("agg_bucket_selector", "SELECT * FROM (SELECT c_nationkey AS key, count(*) AS doc_count, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1 ORDER BY doc_count DESC, key LIMIT 30) WHERE mean > 4500")
def agg_bucket_selector(spark, sf):
    spec = {"terms": {"field": "c_nationkey", "size": 30}, "aggs": {"mean": {"avg": {"field": "c_acctbal"}}, "rich": {"bucket_selector": {"buckets_path": {"m": "mean"}, "script": "m > 4500"}}}}
    return agg(spark, sf, "customer", spec).withColumn("mean", F.round("mean", 4))


@query("agg_significant_terms", "WITH f AS (SELECT o_custkey AS key, count(*) AS doc_count, sum(count(*)) OVER () AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT o_custkey AS key, count(*) AS bg_count, sum(count(*)) OVER () AS n FROM orders GROUP BY 1) SELECT f.key, doc_count, bg_count, round((doc_count / f.n - bg_count / b.n) * (doc_count / f.n) / (bg_count / b.n), 9) AS score FROM f JOIN b ON f.key = b.key WHERE doc_count / f.n > bg_count / b.n ORDER BY (doc_count / f.n - bg_count / b.n) * (doc_count / f.n) / (bg_count / b.n) DESC, f.key LIMIT 20")
def agg_significant_terms(spark, sf):
    d = agg(spark, sf, "orders", {"significant_terms": {"field": "o_custkey", "min_doc_count": 1, "size": 20}}, lambda r: r.filter({"term": {"o_orderstatus": "P"}}))
    return d.withColumn("score", F.round("score", 9))


@query("agg_sampler", "SELECT o_orderpriority AS key, count(*) AS doc_count FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 200) GROUP BY 1")
def agg_sampler(spark, sf):
    return agg(spark, sf, "orders", {"sampler": {"shard_size": 200}, "aggs": {"p": {"terms": {"field": "o_orderpriority"}}}}, lambda r: r.filter(F1))


# -- fetch ------------------------------------------------------------------------------------------------------


@query("source_includes", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size = 7")
def source_includes(spark, sf):
    r = index(spark, sf, "part").filter({"term": {"p_size": 7}}).source(includes=["p_*"], excludes=["p_brand", "p_type", "p_size"])
    return r.search.page(everything=True).select("p_partkey", "p_name", "p_retailprice")


@query("script_field", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-09-01'")
def script_field(spark, sf):
    r = index(spark, sf, "lineitem").filter({"range": {"l_shipdate": {"gte": "1998-09-01"}}}).script_fields({"revenue": {"script": "round(l_extendedprice * (1 - l_discount), 4)"}})
    return r.search.page(everything=True).select("l_orderkey", "l_linenumber", "revenue")


@query("script_params", "SELECT c_custkey, 'O''Neil ' || c_name AS said FROM customer WHERE 'a''b' <> c_name AND c_acctbal > 100.5 AND c_nationkey IN (1, 2)")
def script_params(spark, sf):
    test = {"script": {"script": {"source": "params.odd <> c_name and c_acctbal > params.least and array_contains(params.all, c_nationkey)", "params": {"odd": "a'b", "least": 100.5, "all": [1, 2]}}}}
    r = index(spark, sf, "customer").filter(test).script_fields({"said": {"script": {"source": "concat(params.who, ' ', c_name)", "params": {"who": "O'Neil"}}}})
    return r.search.page(everything=True).select("c_custkey", "said")


@query("highlight", "SELECT p_partkey, regexp_replace(p_name, '(?i)\\b(widget)\\b', '<em>\\1</em>', 'g') AS marked FROM part WHERE list_contains(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'), 'widget')")
def highlight(spark, sf):
    r = index(spark, sf, "part").query({"match": {"p_name": "widget"}}).highlight({"fields": {"p_name": {"number_of_fragments": 0}}})
    return r.search.page(everything=True).select("p_partkey", F.col("_highlight")["p_name"][0].alias("marked"))


@query("suggest_terms", "WITH v AS (SELECT w AS text, count(*) AS freq FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'))) AS w FROM part) GROUP BY 1) SELECT text, round(1 - levenshtein('plaet', text) / CAST(least(5, length(text)) AS DOUBLE), 6) AS score, freq FROM v WHERE length(text) >= 4 AND text[1] = 'p' AND levenshtein('plaet', text) <= 2 ORDER BY score DESC, freq DESC, text LIMIT 5")
def suggest_terms(spark, sf):
    r = index(spark, sf, "part").suggest({"s": {"text": "plaet", "term": {"field": "p_name"}}})
    return r.suggest_frame("s").select("text", F.round("score", 6).alias("score"), "freq")


# -- vectors ----------------------------------------------------------------------------------------------------

QUERY_VECTOR = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
_COS = "(1 + list_dot_product(CAST(embedding AS DOUBLE[]), {v}) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product({v}, {v})))) / 2"
COS = _COS.format(v="CAST(" + str(QUERY_VECTOR) + " AS DOUBLE[])")


@query("knn_topk", f"SELECT vec_id, round({COS}, 6) AS score FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 10")
def knn_topk(spark, sf):
    return index(spark, sf, "embeddings").knn({"field": "embedding", "query_vector": QUERY_VECTOR, "k": 10}).limit(10).frame().select("vec_id", F.round("_score", 6).alias("score"))


@query("knn_filtered", f"SELECT vec_id, round({COS}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY {COS} DESC, vec_id LIMIT 5")
def knn_filtered(spark, sf):
    return index(spark, sf, "embeddings").knn({"field": "embedding", "query_vector": QUERY_VECTOR, "k": 5, "filter": {"term": {"label": 3}}}).limit(5).frame().select("vec_id", F.round("_score", 6).alias("score"))


# -- nested, parents, joins -------------------------------------------------------------------------------------


def nested_orders(spark, sf) -> Index:
    def rows() -> DataFrame:
        lines = table(spark, sf, "lineitem")
        return joins.lookup_many(table(spark, sf, "orders"), lines, "o_orderkey", "l_orderkey", "items", F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag")))

    return Index("orders", frame=rows, id_column="o_orderkey", nested=("items",))


@query("nested_match", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45 AND l_returnflag = 'R')")
def nested_match(spark, sf):
    q = {"nested": {"path": "items", "query": {"bool": {"must": [{"range": {"items.quantity": {"gt": 45}}}, {"term": {"items.flag": "R"}}]}}}}
    return ids(nested_orders(spark, sf).query(q), "o_orderkey")


@query("flattened_match", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def flattened_match(spark, sf):
    return ids(nested_orders(spark, sf).filter({"range": {"items.quantity": {"gt": 45}}}).filter({"term": {"items.flag": "R"}}), "o_orderkey")


@query("nested_agg", "SELECT l_returnflag AS key, count(*) AS doc_count, round(avg(l_quantity), 6) AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def nested_agg(spark, sf):
    spec = {"nested": {"path": "items"}, "aggs": {"flag": {"terms": {"field": "items.flag"}, "aggs": {"q": {"avg": {"field": "items.quantity"}}}}}}
    return nested_orders(spark, sf).aggs({"a": spec}).aggs_frame("a").withColumn("q", F.round("q", 6))


@query("agg_reverse_nested", "SELECT l_returnflag AS key, o_orderpriority AS priority, count(DISTINCT o_orderkey) AS doc_count FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2")
def agg_reverse_nested(spark, sf):
    flag = {"terms": {"field": "items.flag"}, "aggs": {"up": {"reverse_nested": {}, "aggs": {"priority": {"terms": {"field": "o_orderpriority"}}}}}}
    r = nested_orders(spark, sf).aggs({"a": {"nested": {"path": "items"}, "aggs": {"flag": flag}}})
    return r.aggs_frame("a")


def turns(spark, sf) -> Index:
    """Conversations as a join: turn 0 is the parent, the others its children."""
    def rows() -> DataFrame:
        c = table(spark, sf, "conversations")
        first = F.col("turn") == 0
        name = F.concat_ws("-", "conv_id", "turn")
        relation = F.struct(F.when(first, "opening").otherwise("reply").alias("name"), F.when(~first, F.concat_ws("-", "conv_id", F.lit(0))).alias("parent"))
        return c.select(name.alias("_id"), "conv_id", "turn", "role", "text", relation.alias("relation"))

    return Index("turns", frame=rows, id_column="_id", text={"text": "standard"}, join_field="relation")


TOK_C = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


@query("has_child", "SELECT conv_id FROM conversations p WHERE turn = 0 AND (SELECT count(*) FROM conversations c WHERE c.conv_id = p.conv_id AND c.turn > 0 AND c.role = 'assistant') >= 2")
def has_child(spark, sf):
    return ids(turns(spark, sf).filter({"has_child": {"type": "reply", "query": {"term": {"role": "assistant"}}, "min_children": 2}}), "conv_id")


@query("has_parent", f"SELECT conv_id, turn FROM conversations c WHERE turn > 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0 AND list_contains({TOK_C}, 'the'))")
def has_parent(spark, sf):
    return ids(turns(spark, sf).filter({"has_parent": {"parent_type": "opening", "query": {"match": {"text": "the"}}}}), "conv_id", "turn")


@query("descendants", "WITH RECURSIVE links AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), d AS (SELECT 'r1' AS id, 0 AS level UNION ALL SELECT l.id, level + 1 FROM links l JOIN d ON l.parent = d.id) SELECT id, level FROM d")
def descendants(spark, sf):
    nation, customer, region = (table(spark, sf, t) for t in ("nation", "customer", "region"))
    tree = region.selectExpr("concat('r', r_regionkey) id", "cast(null as string) parent").unionByName(nation.selectExpr("concat('n', n_nationkey) id", "concat('r', n_regionkey) parent")).unionByName(customer.selectExpr("concat('c', c_custkey) id", "concat('n', c_nationkey) parent"))
    return joins.descendants(tree, spark.createDataFrame([("r1",)], "id string"), "id", F.col("parent"), 2)


@query("crutch_denormalize", "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name AS name, n_name AS nation, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def crutch_denormalize(spark, sf):
    m = IndexMapping(
        [Field("name", "keyword", value="c_name"), Field("nation", "keyword", value=lambda r, c: c.nation_name), Field("n_orders", "long", value=lambda r, c: F.size(c.orders_keys).cast("long"))],
        id="c_custkey",
        crutches={"nation": Crutch(lambda: table(spark, sf, "nation"), "c_nationkey", "n_nationkey", one={"n_name": "name"}), "orders": Crutch(lambda: table(spark, sf, "orders"), "c_custkey", "o_custkey", many={"keys": F.col("o_orderkey")})},
    )
    return m.compose(table(spark, sf, "customer"))


@query("load_objects_scoped", "SELECT o_orderkey, c_name FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30) LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def load_objects_scoped(spark, sf):
    hits = index(spark, sf, "orders").order({"o_totalprice": "desc"}, "o_orderkey").limit(30).frame().withColumn("_id", F.col("o_custkey").cast("string"))
    loaded = joins.load_frame(hits, table(spark, sf, "customer"), "c_custkey", lambda d: d.filter("c_acctbal > 0"))
    return loaded.select("o_orderkey", F.col("object.c_name").alias("c_name"))


@query("multi_index", "SELECT idx, id, nation FROM (SELECT 'customer' AS idx, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier) WHERE nation IN (1, 2)")
def multi_index(spark, sf):
    c = Index("customer", frame=lambda: table(spark, sf, "customer").selectExpr("c_custkey id", "c_nationkey nation"), id_column="id")
    s = Index("supplier", frame=lambda: table(spark, sf, "supplier").selectExpr("s_suppkey id", "s_nationkey nation", "s_name"), id_column="id")
    return Request(c).indices(s).filter({"terms": {"nation": [1, 2]}}).matching().select(F.col("_index").alias("idx"), "id", "nation")


@query("json_props_filter", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50")
def json_props_filter(spark, sf):
    rows = lambda: table(spark, sf, "events").withColumn("props", F.from_json("props", "k int"))
    r = Index("events", frame=rows, id_column="event_id").filter({"range": {"props.k": {"gte": 50}}})
    return r.matching().select("event_id", F.col("props.k").alias("k"))


# -- ingest -----------------------------------------------------------------------------------------------------


def merged(old: DataFrame, ops: DataFrame, spark: SparkSession, fields: list[str] | None = None) -> DataFrame:
    """Documents after a merge, in a store of the shared folder."""
    from tessera.sources.store import Store

    store = Store(spark, shared(spark, "stores"), "index")
    store.write(old)
    store.merge(ops, fields)
    return store.read()


def order_docs(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("cast(o_orderkey as string) _id", "o_orderstatus status", "o_totalprice price")


@query("import_merge", "SELECT CAST(o_orderkey AS VARCHAR) AS _id, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'new', 'N', 1.5")
def import_merge(spark, sf):
    docs = order_docs(spark, sf)
    key = F.col("_id").cast("long")
    new = docs.filter((key % 3 == 0) & (key % 5 != 0)).withColumn("status", F.lit("X")).withColumn("_op", F.lit("index"))
    gone = docs.filter(key % 5 == 0).select("_id", F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("price"), F.lit("delete").alias("_op"))
    more = spark.createDataFrame([("new", "N", 1.5, "index")], "_id string, status string, price double, _op string")
    return merged(docs, new.unionByName(gone).unionByName(more), spark).select("_id", "status", "price")


@query("partial_update", "SELECT CAST(o_orderkey AS VARCHAR) AS _id, CASE WHEN o_orderkey % 2 = 0 THEN 'U' ELSE o_orderstatus END AS status, o_totalprice AS price FROM orders")
def partial_update(spark, sf):
    docs = order_docs(spark, sf)
    ops = docs.filter(F.col("_id").cast("long") % 2 == 0).select("_id", F.lit("U").alias("status"), F.lit("update").alias("_op"))
    absent = spark.createDataFrame([("absent", "U", "update")], "_id string, status string, _op string")
    return merged(docs, ops.unionByName(absent), spark, ["status"]).select("_id", "status", "price")


@query("delete_by_query", "SELECT CAST(o_orderkey AS VARCHAR) AS _id FROM orders WHERE NOT coalesce(o_totalprice > 100000, false)")
def delete_by_query(spark, sf):
    docs = order_docs(spark, sf)
    found = Index("orders", frame=docs, id_column="_id").filter({"range": {"price": {"gt": 100000}}}).matching()
    return merged(docs, found.select("_id", F.lit("delete").alias("_op")), spark).select("_id")


@query("sync_diff", "WITH a AS (SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_totalprice AS p FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT CAST(o_orderkey AS VARCHAR) AS _id, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 13 <> 0) SELECT coalesce(a._id, b._id) AS _id, CASE WHEN b._id IS NULL THEN 'missing' WHEN a._id IS NULL THEN 'extra' WHEN a.p <> b.p THEN 'outdated' ELSE 'same' END AS state FROM a FULL OUTER JOIN b ON a._id = b._id")
def sync_diff(spark, sf):
    from tessera.sources.syncer import Syncer

    orders = table(spark, sf, "orders")
    stored = orders.filter("o_orderkey % 13 <> 0").selectExpr("cast(o_orderkey as string) _id", "case when o_orderkey % 11 = 0 then o_totalprice + 1 else o_totalprice end updated_at")
    source = orders.filter("o_orderkey % 7 <> 0").selectExpr("o_orderkey id", "o_totalprice updated_at")
    return Syncer(Index("orders", mapping=IndexMapping([Field("updated_at", "double")]), source=lambda: source, frame=stored)).compare()


@query("journal_replay", "SELECT event_type AS index_name, CAST(user_id AS VARCHAR) AS reference FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 SECOND GROUP BY 1, 2")
def journal_replay(spark, sf):
    from datetime import datetime

    from tessera.sources.journal import Journal

    journal = Journal(spark, shared(spark, "journals"))
    entries = table(spark, sf, "events").groupBy(F.col("event_type").alias("index_name"), F.col("ts").cast("timestamp_ntz").alias("created_at")).agg(F.collect_set(F.col("user_id").cast("string")).alias("references"))
    entries.select("index_name", F.lit("index").alias("action"), "references", "created_at").write.parquet(journal.segment())
    return journal.references(datetime(2024, 1, 20))


def stored_orders(spark, sf, **more) -> Index:
    """An index of its own folder over changing source rows: `rows` holds the DataFrame that is the source now."""
    held = {"rows": table(spark, sf, "orders").selectExpr("o_orderkey id", "o_orderstatus status", "o_totalprice price", "o_orderpriority note")}
    mapping = IndexMapping([Field("status", "keyword"), Field("price", "double"), Field("note", "text")])
    own = Index("orders", mapping=mapping, source=lambda: held["rows"], root=shared(spark, "indexes"), **more)
    own.held = held
    return own


CHANGED = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 4 = 0 THEN -1.0 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 9 <> 0"


def changed(rows: DataFrame) -> DataFrame:
    four = F.col("id") % 4 == 0
    return rows.filter("id % 9 <> 0").withColumn("status", F.when(four, "X").otherwise(F.col("status"))).withColumn("price", F.when(four, -1.0).otherwise(F.col("price")))


@query("importer_fields", "SELECT CAST(o_orderkey AS VARCHAR) AS _id, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 9 <> 0 THEN 'X' ELSE o_orderstatus END AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 9 <> 0")
def importer_fields(spark, sf):
    """A whole import; then the status alone of all rows that the changed source holds, and all of each fifth order, which deletes those gone."""
    own = stored_orders(spark, sf)
    own.import_()
    all_ids = own.held["rows"].select("id")
    own.held["rows"] = changed(own.held["rows"])
    own.import_(own.source_rows(), update_fields=["status"])
    own.import_(Ids(all_ids.filter("id % 5 = 0 and id % 9 = 0").select(F.col("id").alias("_id"))))
    return own.documents().select("_id", "status", "price")


@query("journal_apply", f"SELECT CAST(id AS VARCHAR) AS _id, status, price FROM ({CHANGED})")
def journal_apply(spark, sf):
    """What the journal says of one import is imported again from the source as it is by then."""
    from tessera.sources.journal import Journal, now

    own, journal, began = stored_orders(spark, sf), Journal(spark, shared(spark, "journals")), now()
    own.import_(journal=journal)
    own.held["rows"] = changed(own.held["rows"])
    journal.apply(began, [own])
    return own.documents().select("_id", "status", "price")


@query("sync_perform", f"SELECT CAST(id AS VARCHAR) AS _id, status, price FROM ({CHANGED})")
def sync_perform(spark, sf):
    from tessera.sources.syncer import Syncer

    own = stored_orders(spark, sf)
    own.import_()
    own.held["rows"] = changed(own.held["rows"])
    Syncer(own, "price").perform()
    return own.documents().select("_id", "status", "price")


@query("request_delete_all", "SELECT CAST(o_orderkey AS VARCHAR) AS _id FROM orders WHERE NOT coalesce(o_totalprice > 100000 AND o_orderstatus = 'F', false)")
def request_delete_all(spark, sf):
    own = stored_orders(spark, sf)
    own.import_()
    own.filter({"range": {"price": {"gt": 100000}}}).filter({"term": {"status": "F"}}).delete_all()
    return own.documents().select("_id")


@query("journal_clean", "SELECT event_type AS index_name, CAST(user_id AS VARCHAR) AS reference FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' OR event_type <> 'click' GROUP BY 1, 2")
def journal_clean(spark, sf):
    from datetime import datetime

    from tessera.sources.journal import Journal

    journal = Journal(spark, shared(spark, "journals"))
    entries = table(spark, sf, "events").groupBy(F.col("event_type").alias("index_name"), F.col("ts").cast("timestamp_ntz").alias("created_at")).agg(F.collect_set(F.col("user_id").cast("string")).alias("references"))
    entries.select("index_name", F.lit("index").alias("action"), "references", "created_at").write.parquet(journal.segment())
    journal.clean(datetime(2024, 1, 15), ["click"])
    return journal.references(datetime(2000, 1, 1))


@query("delayed_chunks", "SELECT event_type, CAST((floor(epoch(ts) / 3600) + 1) * 3600 AS BIGINT) AS chunk, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2")
def delayed_chunks_query(spark, sf):
    d = delayed_chunks(table(spark, sf, "events"), "ts", "user_id", "event_type", latency=3600)
    return d.select("event_type", "chunk", F.size("ids").cast("long").alias("n"))
