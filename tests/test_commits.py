"""Commits over several tables: all or nothing, conflicts, increments, compaction."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.plans.config import Config
from docloom.plans.tools import Library
from docloom.sources import commits
from docloom.sources.commits import Change, Conflict, Store
from docloom.streaming import flows

A = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.StringType())])
B = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("t", T.StringType())])
NOW = datetime(2024, 7, 1)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"), {"a": A, "b": B}, {"b": "doc_id"})


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def a(spark, *values):
    return spark.createDataFrame(list(values), A)


def b(spark, *values):
    return spark.createDataFrame(list(values), B)


def test_tables_change_together(spark, store, monkeypatch):
    assert rows(store.read("a")) == rows(store.read("b")) == [] and store.snapshot().version == 0
    store.append(a=a(spark, (1, "one"), (2, "two")), b=b(spark, ("d", 0, "x")))
    old = store.snapshot()
    write, calls = Store._write, []

    def fails(self, df, name, kind):
        calls.append(name)
        if len(calls) == 2:
            raise RuntimeError("lost")  # after the first table's new folder, before the second's
        return write(self, df, name, kind)

    monkeypatch.setattr(Store, "_write", fails)
    with pytest.raises(RuntimeError, match="lost"):
        store.append(a=a(spark, (3, "three")), b=b(spark, ("d", 1, "y")))
    monkeypatch.undo()
    assert calls == ["a", "b"] and store.snapshot() == old and rows(store.read("a")) == [(1, "one"), (2, "two")] and rows(store.read("b")) == [("d", 0, "x")]
    assert store.vacuum(older_than=timedelta(0)) == 1  # the folder that belongs to no state
    store.append(a=a(spark, (3, "three")))
    assert rows(store.read("a")) == [(1, "one"), (2, "two"), (3, "three")] and rows(store.read("a", old)) == [(1, "one"), (2, "two")]


def test_the_second_of_two_writers_is_told(spark, store):
    at = store.snapshot()
    store.commit(at, {"a": Change(a(spark, (1, "first")))})
    with pytest.raises(Conflict):
        store.commit(at, {"a": Change(a(spark, (1, "second")))})
    tried = []

    def make(at):
        tried.append(at.version)
        if len(tried) == 1:
            store.append(a=a(spark, (2, "between")))
        return {"a": Change(a(spark, (3, str(at.version))))}

    store.transact(make)
    assert tried == [1, 2] and rows(store.read("a")) == [(1, "first"), (2, "between"), (3, "2")]
    always = lambda at: store.append(a=a(spark, (9, "x"))) and {}
    with pytest.raises(Conflict):
        store.transact(always)


def test_only_folders_with_the_rows_are_written_anew(spark, store):
    for i in range(3):
        store.append(a=a(spark, (i, "x"), (10 + i, "y")))
    before = store.snapshot()
    store.transact(lambda at: {"a": store.without("a", at, spark.createDataFrame([(11,)], "id long"), "id")})
    after = store.snapshot()
    assert len(set(before.folders("a")) & set(after.folders("a"))) == 2 and (11, "y") not in rows(store.read("a")) and store.read("a").count() == 5
    store.transact(lambda at: {"a": store.updated("a", at, F.col("id") == 12, lambda df: df.withColumn("x", F.when(F.col("id") == 12, "new").otherwise(F.col("x"))))})
    assert (12, "new") in rows(store.read("a")) and (2, "x") in rows(store.read("a"))
    none = store.without("a", store.snapshot(), spark.createDataFrame([(99,)], "id long"), "id")
    assert none.add is None and not none.drop


def test_increments_by_key(spark, store):
    store.append(b=b(spark, ("p", 0, "1"), ("p", 1, "2"), ("q", 0, "3")))
    first = store.snapshot()
    put = lambda n: store.transact(lambda _: {"b": store.put("b", b(spark, ("p", 0, "new"), ("r", 0, "4")))}, ("stream", n))
    for n in (0, 0):  # the second time it is there already
        put(n)
    want = [("p", 0, "new"), ("q", 0, "3"), ("r", 0, "4")]
    assert rows(store.read("b")) == want and store.snapshot().version == 2
    assert set(first.folders("b")) < set(store.snapshot().folders("b"))  # the old rows were not written again
    store.transact(lambda at: {"b": store.without("b", at, spark.createDataFrame([("q",)], "doc_id string"), "doc_id")})
    want.remove(("q", 0, "3"))
    assert rows(store.read("b")) == want
    store.compact("b")
    at = store.snapshot()
    assert rows(store.read("b")) == want and len(at.folders("b")) == len(at.folders("b", "keys")) == 1 and at.batches == {"stream": 0}
    store.append(b=b(spark, ("q", 5, "again")))
    assert rows(store.read("b")) == sorted([*want, ("q", 5, "again")])
    assert store.vacuum(older_than=timedelta(0)) > 0 and rows(store.read("b")) == sorted([*want, ("q", 5, "again")])
    with pytest.raises(Exception):  # noqa: B017
        store.snapshot(1)


def test_compaction_beside_a_large_folder_brings_no_replaced_rows_back(spark, store):
    store.append(b=spark.range(2000).select((F.col("id") % 50).cast("string").alias("doc_id"), F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("t")))
    for batch in ("x", "y"):
        store.append(b=spark.createDataFrame([(str(i), 0, batch) for i in range(0, 50, 2)], B))
    store.transact(lambda at: {"b": store.without("b", at, spark.createDataFrame([("1",)], "doc_id string"), "doc_id")})
    want, sizes = rows(store.read("b")), [p["bytes"] for p in store.snapshot().tables["b"] if p["kind"] == "rows"]
    assert len(want) == 25 + 24 * 40
    store.compact("b", small=sizes[0])  # the first folder stays
    at = store.snapshot()
    assert len(at.folders("b")) == 2 and len(at.folders("b", "keys")) == 1
    assert rows(store.read("b")) == want
    store.compact("b", small=2 * sizes[0])
    assert len(store.snapshot().folders("b")) == 1 and rows(store.read("b")) == want


def test_deleting_a_collection_takes_all_that_hangs_on_it(spark, tmp_path, monkeypatch):
    lib = Library(spark, str(tmp_path), Config(as_of=NOW))
    one, two = lib.create_collection("One"), lib.create_collection("Two")
    for c in (one, two):
        lib.add_document(c, "Doc", "Some words of a text. " * 60)
    state = lambda: tuple(lib.table(n).count() for n in ("collections", "documents", "chunks"))
    full = state()
    assert full[:2] == (2, 2) and full[2] % 2 == 0
    publish = Store._publish

    def dies(self, made):
        raise RuntimeError("lost")

    monkeypatch.setattr(Store, "_publish", dies)
    with pytest.raises(RuntimeError):
        lib.delete_collection(one)
    assert state() == full
    monkeypatch.setattr(Store, "_publish", publish)
    lib.delete_collection(one)
    assert state() == (1, 1, full[2] // 2) and [r.name for r in lib.list_collections().collect()] == ["Two"]
    left = lib.table("documents").first()
    assert left.collection_id == two and {r.doc_id for r in lib.table("chunks").select("doc_id").collect()} == {left.id}
    lib.restart_ingest(left.id)  # no file path: stays
    assert lib.get_document_status(left.id).first().status == "complete"
    lib.delete_document(left.id)
    assert state() == (1, 0, 0)


def test_ingest_stream_into_a_store(spark, tmp_path):
    kind = "id string, text string, error string, metadata map<string,string>, file_path string, content_type string"
    chunk = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType())])
    store = Store(spark, f"{tmp_path}/s", {"chunks": chunk}, {"chunks": "doc_id"})
    run = lambda checkpoint: flows.ingest_to_store(spark.readStream.schema(kind).parquet(f"{tmp_path}/docs"), store, f"{tmp_path}/{checkpoint}").awaitTermination(120)
    for text in ("Some text. " * 100, "Other text. " * 40):
        spark.createDataFrame([("a", text, None, None, None, "text/plain")], kind).write.mode("append").parquet(f"{tmp_path}/docs")
        run("c")
    assert store.snapshot().version == 2 and {r.text[:5] for r in store.read("chunks").collect()} == {"Other"}
    run("another")  # its batch 0 is known by the stream's name: nothing is written
    assert store.snapshot().version == 2 and commits.SEQ not in store.read("chunks").columns


def test_typed_metadata_keeps_its_types(spark):
    from docloom.functions import metadata
    from docloom.operators import catalog

    given = [
        ('{"stars":1200,"b":{"x":[1,2.5,null]},"c":true}', '{"page":3,"b":{"z":"q"}}', '{"b":{"z":"q"},"c":true,"page":3,"stars":1200}'),
        (None, '{"a":[]}', '{"a":[]}'), ("[1]", '{"a":1}', '{"a":1}'), ("no json", None, "{}"), ('{"a":null}', '{"b":null}', '{"a":null,"b":null}'), ('{"a":"1"}', '{"a":1}', '{"a":1}'),
    ]
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], "id int, l string, r string, want string")
    assert all(r[0] == r[1] for r in df.select(metadata.typed_merged(F.col("l"), F.col("r")), "want").collect())
    typed = df.select("id", F.try_parse_json("l").alias("metadata"), F.try_parse_json("r").alias("more"))
    found = catalog.merge_metadata(typed, F.col("id") == 0, F.col("more")).orderBy("id").select(F.to_json("metadata"), metadata.value(F.col("metadata"), "$.stars", "int"), metadata.value(F.col("metadata"), "$.c", "int")).collect()
    assert [tuple(r) for r in found[:2]] == [(given[0][2], 1200, 1), (None, None, None)] and found[5][0] == '{"a":"1"}'


def test_chunks_and_vectors_must_agree_in_number(spark, store):
    from docloom.operators import embed

    chunks = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "doc_id string, chunk_index int, text string")
    vectors = lambda *rows: spark.createDataFrame(list(rows), "doc_id string, chunk_index int, embedding array<float>")
    got = {(r.doc_id, r.chunk_index): r.embedding for r in embed.paired(chunks, vectors(("a", 0, [1.0]), ("a", 1, [2.0]))).collect()}
    assert got == {("a", 0): [1.0], ("a", 1): [2.0], ("b", 0): None}
    assert embed.paired(chunks, vectors()).count() == 3
    for bad in (vectors(("a", 0, [1.0])), vectors(("a", 0, [1.0]), ("a", 1, [2.0]), ("a", 2, [3.0])), vectors(("c", 0, [1.0]))):
        with pytest.raises(Exception, match="differ in number"):
            embed.paired(chunks, bad).collect()
