"""Composition, imports, journal, synchronisation, lifecycle, strategies and feeds."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera import admin
from tessera.events import subscribe
from tessera.functions.analysis import REGISTRY, Analyzer, keyword_token
from tessera.sources.fields import Crutch, Field, IndexMapping
from tessera.sources.importer import Importer, ImportFailed
from tessera.sources.index import Config, Index
from tessera.sources.journal import Journal, now
from tessera.sources.syncer import Syncer
from tessera.streaming import feed
from tessera.streaming.strategy import Observer, UndefinedStrategy, current, strategy


class Rows:
    """A source table that tests change."""

    def __init__(self, spark, schema, rows):
        self.spark, self.schema, self.rows = spark, schema, list(rows)

    def __call__(self):
        return self.spark.createDataFrame(self.rows, self.schema)


def docs(index, *columns):
    return sorted(tuple(r) for r in index.documents().select("_id", *columns).collect())


@pytest.fixture
def cities(spark, root):
    rows = Rows(spark, "id int, name string, rating int, updated_at timestamp", [(i, f"Name{i}", i, datetime(2024, 1, i)) for i in (1, 2, 3)])
    mapping = IndexMapping([Field("name", "text"), Field("rating", "integer"), Field("updated_at", "date")])
    index = Index("cities", mapping=mapping, source=rows, root=root)
    index.rows = rows
    return index


def test_compose(spark):
    schema = "id int, name string, country struct<id:int,title:string,cities:array<struct<id:int,name:string>>>, tags array<string>, note string"
    rows = spark.createDataFrame([(1, "A", (7, "X", [(1, "a"), (2, None)]), ["t"], ""), (2, None, None, None, "n")], schema)
    m = IndexMapping(
        [
            Field("title", "keyword", value="name"),
            Field("upper", "keyword", value=lambda r: F.upper(r.name)),
            Field("country", children=[Field("id", "integer"), Field("full", "keyword", value=lambda c, row: F.concat(c.title, F.lit("/"), row["name"])), Field("cities", "object", many=True, children=[Field("name", "keyword"), Field("of", "keyword", value=lambda city, country: country["title"])])]),
            Field("tags", "keyword", many=True),
            Field("note", "keyword", ignore_blank=True),
        ]
    )
    one, two = m.compose(rows).orderBy("_id").collect()
    assert (one._id, one.title, one.upper, one.tags, one.note) == ("1", "A", "A", ["t"], None)
    assert (one.country.id, one.country.full, [tuple(c) for c in one.country.cities]) == (7, "X/A", [("a", "X"), (None, "X")])
    assert (two.title, two.country, two.tags, two.note) == (None, None, None, "n")
    assert m.compose(rows, only=["title"]).columns == ["_id", "title"]
    assert IndexMapping(id=lambda r: F.concat(F.lit("x"), r.id)).compose(rows).columns == [*rows.columns, "_id"]


def test_geo_points_drop_what_is_blank(spark):
    rows = spark.createDataFrame([(1, ("52.5", "13.4")), (2, (None, None)), (3, None)], "id int, p struct<lat:string,lon:string>")
    assert [r.p for r in IndexMapping([Field("p", "geo_point")]).compose(rows).orderBy("_id").collect()] == [(52.5, 13.4), None, None]


def test_mapping_and_templates():
    m = IndexMapping([Field("name", fields=[Field("raw", "keyword")]), Field("o", children=[Field("n", "integer")])])
    m.template("template*", "boolean")
    m.template("tit.*")
    import re

    m.template(re.compile(r"tit.+"), "integer")
    m.template(re.compile(r"\.tit.+"), "keyword")
    d = m.to_dict()["mappings"]
    assert d["properties"] == {"name": {"type": "text", "fields": {"raw": {"type": "keyword"}}}, "o": {"type": "object", "properties": {"n": {"type": "integer"}}}}
    assert [next(iter(t)) for t in d["dynamic_templates"]] == [f"template_{i}" for i in (1, 2, 3, 4)]
    assert m.dynamic_type("template9") == "boolean" and m.dynamic_type("xtitle") == "integer"


def test_import(cities):
    assert cities.import_() and docs(cities, "name") == [("1", "Name1"), ("2", "Name2"), ("3", "Name3")]
    cities.rows.rows = [(2, "New", 5, None), (4, "Four", 4, None)]
    assert cities.import_([2, 3, 4])  # 3 is gone from the source
    assert docs(cities, "name", "rating") == [("1", "Name1", 1), ("2", "New", 5), ("4", "Four", 4)]
    assert cities.import_([])
    assert cities.import_([{"id": 9, "name": "Dict"}]) and ("9", "Dict") in docs(cities, "name")
    assert cities.query({"match": {"name": "dict"}}).count() == 1


def test_import_is_the_same_in_parts(cities, spark, root):
    other = Index("parts", mapping=cities.mapping, source=cities.rows, root=root)
    cities.import_()
    for i in (3, 1, 2):
        other.import_([i])
    assert docs(other, "name", "rating") == docs(cities, "name", "rating")


def test_duplicates_and_deletions_in_a_batch(spark, root):
    rows = spark.createDataFrame([(1, "a", False), (1, "a", False), (2, "b", True), (2, "c", False), (None, "auto", False)], "id int, name string, gone boolean")
    i = Index("dup", mapping=IndexMapping([Field("name", "keyword")]), root=root, delete_if=lambda r: F.col("gone"))
    assert i.import_(rows)
    got = docs(i, "name")
    assert ("1", "a") in got and len(got) == 2 and {n for _, n in got} == {"a", "auto"}


def test_partial_update(cities):
    cities.import_()
    cities.rows.rows = [(1, "One", 100, None), (2, "Two", 200, None), (7, "Seven", 700, None)]
    Importer(cities, update_fields=["name"]).run([1, 7])
    assert docs(cities, "name", "rating") == [("1", "One", 1), ("2", "Name2", 2), ("3", "Name3", 3), ("7", "Seven", 700)]
    Importer(cities, update_fields=["rating"], update_failover=False).run(cities.rows().filter("id = 2"))
    assert ("2", "Name2", 200) in docs(cities, "name", "rating")


def test_errors_don_t_stop_the_others(cities):
    bad = {"too low": lambda: F.col("rating") < 2}
    assert not cities.import_(validate=bad)
    assert [d[0] for d in docs(cities)] == ["2", "3"]
    with pytest.raises(ImportFailed) as e:
        cities.import_strict(validate=bad)
    assert e.value.errors == {"index": {"too low": ["1"]}}
    with pytest.raises(TypeError):
        cities.import_(nonsense=1)


def test_delete_by_query(cities):
    cities.import_()
    assert cities.filter({"range": {"rating": {"gte": 2}}}).delete_all() == {"deleted": 2}
    assert docs(cities, "name") == [("1", "Name1")]


def test_crutches_and_objects(spark, root):
    names = spark.createDataFrame([(1, "Name42"), (2, "Name43")], "key int, title string")
    rows = Rows(spark, "id int, ref int", [(1, 1), (2, 2), (3, None)])
    m = IndexMapping([Field("name", "keyword", value=lambda r, c: c.names_title), Field("ref", "integer")], crutches={"names": Crutch(lambda: names, "ref", "key", one={"title": "title"})})
    i = Index("crutch", mapping=m, source=rows, root=root)
    i.import_()
    assert docs(i, "name") == [("1", "Name42"), ("2", "Name43"), ("3", None)]
    rows.rows = [(1, 1), (3, None)]
    r = i.order("_id")
    assert [o and o.id for o in r.objects()] == [1, None, 3]
    assert [o and o.id for o in r.load(scope=lambda d: d.filter("id > 1")).objects()] == [None, None, 3]
    assert [h.id for h in r.object_hash()] == ["1", "2", "3"]


def test_join_field(spark, root):
    schema = "id int, content string, kind string, parent int"
    tree = [(1, "q1", "question", None), (2, "a", "answer", 1), (3, "c", "comment", 1), (4, "v", "vote", 2), (5, "q2", "question", None)]
    rows = Rows(spark, schema, tree)
    m = IndexMapping([Field("content", "keyword"), Field("rel", "join", join={"type": "kind", "id": "parent"}, options={"relations": {"question": ["answer", "comment"], "answer": "vote"}})])
    i = Index("tree", mapping=m, source=rows, root=root)
    i.import_()
    ids = lambda r: sorted(h.id for h in r)
    assert ids(i.query({"has_parent": {"parent_type": "question", "query": {"match": {"content": "q1"}}}})) == ["2", "3"]
    assert ids(i.query({"has_child": {"type": "vote", "query": {"match_all": {}}}})) == ["2"]
    assert ids(i.filter().must_not({"has_child": {"type": "answer", "query": {"match_all": {}}}})) == ["2", "3", "4", "5"]
    rows.rows[1] = (2, "a", "answer", 5)
    i.import_([2])
    assert ids(i.query({"has_parent": {"parent_type": "question", "query": {"term": {"content": "q2"}}}})) == ["2"]
    assert len(docs(i)) == 5
    rows.rows.append((6, "x", "nonsense", None))
    with pytest.raises(Exception, match="unknown relation"):
        i.import_()


def test_sync(cities):
    cities.import_()
    assert cities.sync()["count"] == 0
    cities.rows.rows = [(2, "Changed", 2, datetime(2025, 1, 1)), (3, "Name3", 3, datetime(2024, 1, 3, 0, 0, 0, 400)), (4, "New", 4, None)]
    s = Syncer(cities)
    assert sorted(s.missing_ids()) == ["1", "4"] and s.outdated_ids() == ["2"]
    assert Syncer(cities, "nothing").outdated_ids() == []
    assert cities.sync() == {"missing": 1, "extra": 1, "outdated": 1, "count": 3}
    assert docs(cities, "name") == [("2", "Changed"), ("3", "Name3"), ("4", "New")]
    cities.rows.rows = []
    assert cities.sync()["count"] == 0 and len(docs(cities)) == 3


def test_journal(cities, spark, root):
    journal = Journal(spark, root)
    began = now()
    cities.import_(journal=journal)
    assert sorted(r.reference for r in journal.references(began).collect()) == ["1", "2", "3"]
    cities.store.write(cities.documents().filter("_id <> '2'"))
    assert journal.apply(began, [cities]) == 3 and len(docs(cities)) == 3
    assert journal.apply(began + timedelta(hours=1), [cities]) == 0
    assert journal.clean(began - timedelta(hours=1)) == 0
    assert journal.clean(indexes=["other"]) == 0
    assert journal.clean(now() + timedelta(hours=1), [cities]) >= 1 and journal.entries().count() == 0


def test_lifecycle(cities, spark, root):
    assert not cities.exists() and cities.create() and not cities.create() and not cities.changed()
    assert cities.reset("s1") and len(docs(cities)) == 3
    assert cities.store.pointer["version"].endswith("-s1") and len(cities.versions()) == 2
    cities.mapping.fields.append(Field("more", "keyword"))
    assert cities.changed()
    cities.update_mapping()
    assert not cities.changed() and cities.documents().select("more").distinct().collect()[0][0] is None
    copy = Index("copy", mapping=cities.mapping, root=root)
    admin.reindex(cities, copy)
    assert len(docs(copy)) == 3
    assert admin.upgrade([cities]) == [] and admin.deploy([cities])["synced"]["cities"]["count"] == 0
    assert admin.create_missing([cities, Index("fresh", root=root, mapping=IndexMapping([Field("a")]))]) == ["fresh"]
    with pytest.raises(PermissionError):
        admin.massacre([cities])
    assert cities.purge() and docs(cities) == [] and cities.delete() and not cities.delete()
    assert Index("x", prefix="p", suffix="9", root=root).name == "p_x_9"
    assert Config.massacre_allowed is False


def test_strategies(cities):
    with pytest.raises(UndefinedStrategy):
        current().update(cities, [1])
    with strategy("bypass"):
        current().update(cities, [1])
    assert not cities.exists()
    with strategy("atomic"):
        current().update(cities, [1, 2])
        current().update(cities, [2])
        with strategy("urgent"):
            current().update(cities, [3])
            assert [d[0] for d in docs(cities)] == ["3"]
    assert [d[0] for d in docs(cities)] == ["1", "2", "3"]
    with strategy("atomic"):
        Observer(cities, lambda c: c.select(F.col("city_id")), lambda c: F.col("ok")).changed(cities.spark.createDataFrame([(1, True), (2, False)], "city_id int, ok boolean"))
        assert [r[0] for r in current().gathered(cities).frame.collect()] == ["1"]
        cities.rows.rows = [(1, "Again", 1, None)]
    assert docs(cities, "name")[0] == ("1", "Again")


def test_feed(cities, spark, root, tmp_path):
    path, checkpoint = f"{root}/feed", str(tmp_path / "checkpoint")
    with strategy("queued", path):
        current().update(cities, [1, 2, 77])
    for expected in (["1", "2"], ["1", "2", "3"]):
        q = feed.consume(spark, path, {"cities": cities}, checkpoint, once=True)
        q.awaitTermination(120)
        assert q.exception() is None and [d[0] for d in docs(cities)] == expected
        feed.append(spark, path, "cities", [3, 3])
    before = cities.store.pointer
    cities.store.merge(cities.documents().withColumn("_op", F.lit("delete")), batch=next(iter(before["streams"].items())))
    assert cities.store.pointer == before  # a batch that comes again changes nothing


def test_two_feeds_into_one_index(cities, spark, root, tmp_path):
    for n, i in enumerate((1, 2)):  # both streams count their batches from 0
        feed.append(spark, f"{root}/feed{n}", "cities", [i])
        q = feed.consume(spark, f"{root}/feed{n}", {"cities": cities}, str(tmp_path / f"c{n}"), once=True)
        q.awaitTermination(120)
        assert q.exception() is None
    assert [d[0] for d in docs(cities)] == ["1", "2"]


def test_lists_of_fields_in_a_feed(cities, spark, root, tmp_path):
    cities.import_([1, 2])
    cities.rows.rows = [(i, f"New{i}", 100 + i, None) for i in (1, 2, 3)]
    with strategy("queued", f"{root}/feed"):
        current().update(cities, [1], update_fields=["name"])
        current().update(cities, [2], update_fields=["name"])
        current().update(cities, spark.createDataFrame([(2,)], "_id int"))  # all fields win
        current().update(cities, [3], update_fields=["name"])  # isn't there yet: whole
    q = feed.consume(spark, f"{root}/feed", {"cities": cities}, str(tmp_path / "c"), once=True)
    q.awaitTermination(120)
    assert q.exception() is None
    assert docs(cities, "name", "rating") == [("1", "New1", 1), ("2", "New2", 102), ("3", "New3", 103)]


def test_delayed_stream_imports_a_chunk_at_once(cities, spark, root, tmp_path):
    import time

    path = f"{root}/feed"
    feed.append(spark, path, "cities", [1, 2], ["name"])
    q = feed.delayed(spark, path, {"cities": cities}, str(tmp_path / "c"), latency=4, margin=0.5, every="200 milliseconds")
    try:
        feed.append(spark, path, "cities", [2, 3])
        for _ in range(300):
            if cities.exists() and len(docs(cities)) == 3:
                break
            assert q.exception() is None
            time.sleep(0.2)
        assert [d[0] for d in docs(cities)] == ["1", "2", "3"]
    finally:
        q.stop()


def test_delayed_chunks(spark, tmp_path):
    at = [(datetime(2024, 1, 1, 0, 0, s), i, f) for s, i, f in ((0, 1, ["a"]), (9, 1, ["b"]), (10, 2, None), (12, 2, ["c"]))]
    df = spark.createDataFrame(at, "ts timestamp, id int, fields array<string>")
    rows = feed.delayed_chunks(df, "ts", "id", fields="fields").orderBy("chunk").collect()
    assert [(r.chunk % 60, r.run_at - r.chunk, r.ids, r.fields) for r in rows] == [(10, 2, ["1"], ["a", "b"]), (20, 2, ["2"], None)]
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = feed.delayed_chunks(stream, "ts", "id").writeStream.format("memory").queryName("chunks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.chunk % 60 for r in spark.table("chunks").collect()) == [10, 20]


def test_analysis(spark):
    from tessera.functions.analysis import fold_tokens, ngram_tokens, pattern_replace, synonym_tokens

    one = lambda a, s: spark.range(1).select(a(F.lit(s)).alias("t")).first().t
    assert one(REGISTRY.resolve("standard"), "Hello, Wörld 42!") == ["hello", "wörld", "42"]
    assert one(Analyzer(keyword_token), "Mixed Case") == ["mixed case"]
    assert one(Analyzer(ngram_tokens(3, 3)), "abcd") == ["abc", "bcd"] and one(Analyzer(ngram_tokens(3, 3)), "ab") == []
    assert one(Analyzer(char_filters=(pattern_replace("[0-9]", ""),)), "a1b2") == ["ab"]
    assert one(Analyzer(filters=(fold_tokens,)), "Crème Ñu") == ["creme", "nu"]
    assert one(Analyzer(filters=(synonym_tokens({"car": ["auto"]}),)), "my car") == ["my", "car", "auto"]
    settings = {"analyzer": {"tri": {"tokenizer": "t3", "filter": ["lowercase"]}}, "tokenizer": {"t3": {"type": "ngram", "min_gram": 3, "max_gram": 3}}}
    assert one(REGISTRY.resolve("tri", settings), "ABCD") == ["abc", "bcd"]
    with pytest.raises(KeyError):
        REGISTRY.resolve("nothing")
    sounds = lambda e: REGISTRY.resolve("p", {"analyzer": {"p": {"tokenizer": "standard", "filter": ["lowercase", "f"]}}, "filter": {"f": {"type": "phonetic", "encoder": e}}})
    assert one(sounds("nysiis"), "Knight Macdonald Phillipson Schmidt Brown Browne Robert") == ["NAGT", "MCDANALD", "FALAPSAN", "SNAD", "BRAN", "BRAN", "RABAD"]
    assert one(sounds("soundex"), "Robert Rupert") == ["R163", "R163"]
    with pytest.raises(ValueError):
        sounds("other")


def test_documents_are_stored_with_their_tokens(cities):
    cities.import_()
    assert docs(cities, "__tokens_name")[0] == ("1", ["name1"]) and cities.stored_terms() is not None
    assert [h.id for h in cities.query({"match": {"name": "name2"}})] == ["2"]
    cities.rows.rows = [(1, "Other Words", 9, None), (2, "Name2", 2, None)]
    cities.import_([1], update_fields=["name"])
    assert docs(cities, "__tokens_name", "rating")[0] == ("1", ["other", "words"], 1) and cities.stored_terms() is None
    assert [h.id for h in cities.query({"match": {"name": "words"}})] == ["1"]
    assert "__tokens_name" not in cities.limit(1).frame().columns


def test_journal_keeps_what_is_added_during_cleaning(cities, spark, root):
    journal = Journal(spark, root, group=2)
    began = now()
    cities.import_(journal=journal)
    real = journal.read

    def adding(segments=None):
        if segments is not None:
            cities.import_([2], journal=journal)
        return real(segments)

    journal.read = adding
    assert journal.clean(now() + timedelta(hours=1)) >= 2
    journal.read = real
    assert [r.reference for r in journal.references(began).collect()] == ["2"]


def test_all_failures_are_kept(cities):
    cities.rows.rows = [(i, f"n{i}", i, None) for i in range(3000)]
    own = Importer(cities, validate={"low": lambda: F.col("rating") < 2500})
    assert not own.run() and own.error_counts == {"index": {"low": 2500}} and len(own.errors["index"]["low"]) == 1000
    assert own.failed.count() == 2500 and len(docs(cities)) == 500


def test_multi_fields_have_their_own_analysis(spark, root):
    rows = Rows(spark, "id int, name string", [(1, "New York"), (2, "York")])
    m = IndexMapping([Field("name", "text", fields=[Field("sorted", "text", options={"analyzer": "lowercase_keyword"})])])
    i = Index("multi", mapping=m, source=rows, root=root)
    i.import_()
    assert sorted(h.id for h in i.query({"match": {"name": "york"}})) == ["1", "2"]
    assert [h.id for h in i.query({"match": {"name.sorted": "YORK"}})] == ["2"]


def test_events_and_given_hits(cities):
    heard = []
    end = subscribe(lambda name, payload, seconds: heard.append((name, payload.get("errors"))))
    cities.import_()
    cities.limit(1).hits()
    end()
    cities.limit(1).hits()
    assert heard == [("import_objects", {}), ("search_query", None)]
    r = cities.limit(5).respond([{"id": 1, "name": "x"}])
    assert r.performed and [h.name for h in r] == ["x"] and len(r) == 1
    assert sorted(map(tuple, cities.import_references("name").collect())) == [(1, "Name1"), (2, "Name2"), (3, "Name3")]
