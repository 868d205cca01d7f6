"""Stems, the stored index and searches over it."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import stems
from docloom.operators import fulltext, search
from docloom.plans import search as plan
from docloom.plans.config import Config

# Words and stems as the public descriptions of the two stemmers give them.
ENGLISH = (
    "consign:consign consigned:consign consigning:consign consignment:consign consist:consist consisted:consist consistency:consist consistently:consist consolation:consol knack:knack knackeries:knackeri knaves:knave knavish:knavish"
    " kneaded:knead kneading:knead knightly:knight knots:knot caresses:caress ties:tie cries:cri gas:gas this:this gaps:gap kiwis:kiwi agreed:agre feed:feed plastered:plaster bled:bled motoring:motor sing:sing luxuriated:luxuri hopping:hop"
    " hoping:hope cry:cri by:by say:say happy:happi relational:relat conditional:condit generate:generat generously:generous communism:communism arsenal:arsenal skies:sky dying:die news:news herring:herring proceed:proceed exceeds:exceed"
    " rate:rate controlling:control roll:roll cease:ceas probate:probat electricity:electr hopefulness:hope formalize:formal adoption:adopt yes:yes enjoying:enjoy"
)
GERMAN = (
    "aufeinander:aufeinand aufenthalt:aufenthalt aufenthalte:aufenthalt aufenthalts:aufenthalt auferlegt:auferlegt aufgeblasenen:aufgeblas kategorie:kategori kategorien:kategori kategorischer:kategor kategorisches:kategor jähriger:jahrig jahre:jahr"
    " häuser:haus finsternisse:finsternis freundlichkeiten:freundlich bedeutungen:bedeut straße:strass bauen:bau ein:ein"
)


def pairs(text):
    return [tuple(p.split(":")) for p in text.split()]


def test_stems():
    assert [(w, stems.english(w)) for w, _ in pairs(ENGLISH)] == pairs(ENGLISH)
    assert [(w, stems.german(w)) for w, _ in pairs(GERMAN)] == pairs(GERMAN)
    assert len(stems.LANGUAGES["english"].stops) == 127 and "würden" in stems.LANGUAGES["german"].stops and "keinem" in stems.LANGUAGES["german"].stops


def test_language_asked_then_configured_then_english():
    assert [stems.resolve_language(*x) for x in (("German", "simple"), (None, " simple "), (" ", ""), (None, None))] == ["german", "simple", "english", "english"]
    assert Config.from_env({"FTS_LANGUAGE": "german"}).fts_language == "german"
    with pytest.raises(ValueError):
        stems.resolve_language("klingon")


TEXTS = [
    (1, "a", "Running in the gardens, she runs"),
    (2, "a", "The runner of a garden"),
    (3, "b", "to be or not to be the THE"),
    (4, "b", "gardens run; gardening"),
    (5, "a", None),
    (6, "a", ""),
    (7, "b", "run " * 300 + "garden"),
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fulltext") / "index")
    chunks = spark.createDataFrame(TEXTS, "chunk_id long, collection string, text string")
    fulltext.write_index(chunks, path, "english", ("collection",), parts=6)
    return path


def test_stop_words_leave_gaps(spark):
    df = spark.createDataFrame(TEXTS, "chunk_id long, collection string, text string")
    found = {(r.chunk_id, r.term): r.positions for r in fulltext.lexemes(df.repartition(3), ["chunk_id"], "english").collect()}
    assert found[1, "run"] == [1, 6] and found[1, "garden"] == [4] and found[2, "runner"] == [2] and found[2, "garden"] == [5] and found[4, "garden"] == [1, 3]
    assert not any(i in (3, 5, 6) for i, _ in found) and found[7, "garden"] == [301] and len(found[7, "run"]) == 300
    assert fulltext.lexemes(df.limit(0), ["chunk_id"], "german").collect() == []


def test_many_queries_at_once(spark, index):
    asked = [(10, "gardening running", "a"), (11, "gardening running", "b"), (12, "the of", "a"), (13, "garden-running!", "b"), (14, None, "a"), (15, "zebra run", "a"), (16, "ru:* & gard", "a")]
    got = fulltext.search_index(spark, index, spark.createDataFrame(asked, "query_id long, query string, collection string")).collect()
    found = {(r.query_id, r.chunk_id): r for r in got}
    # run is a prefix of runner; query 12 is stop words alone, 15 has a term without match
    assert set(found) == {(10, 1), (10, 2), (11, 4), (11, 7), (13, 4), (13, 7), (16, 1), (16, 2)}
    assert found[10, 1].tf == 3 and found[11, 7].tf == 301 and abs(found[10, 2].density - 0.1 / 3) < 1e-12 and abs(found[10, 1].density - (0.1 / 3 + 0.1 / 2)) < 1e-12
    assert [found[k].rank for k in ((10, 1), (10, 2), (11, 4), (11, 7))] == [1, 2, 1, 2] and found[10, 1].score == 1 and abs(found[11, 7].score - 0.1 / 0.2) < 1e-12


def test_a_prefix_reads_its_range_only(spark, index):
    found = fulltext.postings_of(spark, index, ["gard"])
    said = found._jdf.queryExecution().executedPlan().toString()
    parts = re.search(r"PartitionFilters: \[([^\]]*)\]", said)[1]
    assert "part#" in parts and "StringStartsWith(term,gard)" in said
    assert {r.term for r in found.select("term").distinct().collect()} == {"garden"}
    all_parts = spark.read.parquet(f"{index}/postings").select("part").distinct().count()
    assert 0 < found.select("part").distinct().count() < all_parts
    ranges = spark.read.parquet(f"{index}/ranges").collect()
    rows = spark.read.parquet(f"{index}/postings").collect()
    assert {(r.part, r.first, r.last) for r in ranges} == {(p, min(x.term for x in rows if x.part == p), max(x.term for x in rows if x.part == p)) for p in {x.part for x in rows}}


def test_index_scan_and_words_agree(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, _, t in TEXTS], "chunk_id long, text string")
    fulltext.write_index(df, str(tmp_path / "i"), "simple")
    for query in ("run gard", "garden", "the"):
        one = spark.createDataFrame([(0, query)], "query_id long, query string")
        plain = sorted((r.chunk_id, r.tf, r.score, r["rank"]) for r in search.lexical_search(df, query).collect())
        assert sorted((r.chunk_id, r.tf, r.score, r["rank"]) for r in fulltext.search_index(spark, str(tmp_path / "i"), one, by="tf").collect()) == plain
        assert sorted((r.chunk_id, r.tf, r.score, r["rank"]) for r in fulltext.scan_search(df, query, "simple", by="tf").collect()) == plain
        dense = sorted((r.chunk_id, round(r.density, 9)) for r in search.cover_density_search(df, query).collect())
        assert sorted((r.chunk_id, round(r.density, 9)) for r in fulltext.scan_search(df, query, "simple").collect()) == dense
    assert fulltext.scan_search(df, "the of", "english").collect() == []
    with pytest.raises(ValueError):
        fulltext.scan_search(df, "!()")
    with pytest.raises(ValueError):
        fulltext.search_index(spark, str(tmp_path / "i"), one, by="bm25")


def test_more_prefixes_than_are_named(spark, index, monkeypatch):
    asked = spark.createDataFrame([(i, q, "a") for i, q in enumerate(("gardening running", "runner", "gard"))], "query_id long, query string, collection string")
    few = sorted(fulltext.search_index(spark, index, asked).collect())
    monkeypatch.setattr(fulltext, "PRUNED", 1)
    assert sorted(fulltext.search_index(spark, index, asked).collect()) == few and few


def test_hybrid_of_many_queries_is_that_of_each(spark, tmp_path):
    vec = [(i, g, t, [float(i), 1.0, float(i % 3)]) for i, g, t in TEXTS]
    chunks = spark.createDataFrame(vec, "chunk_id long, collection string, text string, embedding array<double>")
    path = str(tmp_path / "i")
    fulltext.write_index(chunks, path, "english", ("collection",))
    asked = [(1, "gardens", [1.0, 0.0, 0.0], "a"), (2, "running", [0.0, 1.0, 0.0], "b"), (3, "the", [1.0, 1.0, 1.0], "a"), (4, "runs", [1.0, 2.0, 0.0], "nowhere")]
    queries = spark.createDataFrame(asked, "query_id long, query string, embedding array<double>, collection string")
    got = {(r.query_id, r.chunk_id): (round(r.fused_score, 9), r.source, r.fused_rank) for r in fulltext.hybrid_batch(spark, path, chunks, queries, 3, 0.1).collect()}
    want = {}
    for i, q, v, g in asked[:3]:
        mine = chunks.filter(F.col("collection") == g)
        for r in search.hybrid(mine, q, v, 3, 0.1, lexical=lambda n, q=q, mine=mine: fulltext.scan_search(mine, q, "english", n)).collect():
            want[i, r.chunk_id] = (round(r.fused_score, 9), r.source, r.fused_rank)
    assert got == want and {i for i, _ in got} == {1, 2, 3}


def test_search_stems_and_reads_an_index(spark, tmp_path):
    docs = spark.createDataFrame([("a", "c1", "A", None, {}), ("b", "c2", "B", None, {})], "id string, collection_id string, title string, source_url string, metadata map<string,string>")
    rows = [(i, g, t or "", [1.0, float(i)], {}) for i, g, t in TEXTS]
    chunks = spark.createDataFrame(rows, "id long, doc_id string, text string, embedding array<double>, metadata map<string,string>")
    ask = dict(query="gardening", collection="c2", mode="hybrid", vector=[1.0, 0.0], min_similarity=0.9)
    scanned = sorted((r.id, r.lexical_score) for r in plan.search_rag(chunks, docs, **ask).withColumnRenamed("chunk_id", "id").collect())
    assert [i for i, _ in scanned] == [4, 7] and max(s for _, s in scanned) == 1
    plain = plan.search_rag(chunks, docs, **ask, config=Config(fts_language="simple")).collect()
    assert [r.chunk_id for r in plain] == [4]  # only the word itself
    carried = chunks.withColumnRenamed("id", "chunk_id").join(docs.select(F.col("id").alias("doc_id"), "collection_id"), "doc_id")
    fulltext.write_index(carried, str(tmp_path / "i"), carry=("collection_id",))
    assert sorted((r.chunk_id, r.lexical_score) for r in plan.search_rag(chunks, docs, **ask, index=str(tmp_path / "i")).collect()) == scanned
    with pytest.raises(ValueError):
        plan.search_rag(chunks, docs, **{**ask, "collection": None}, index=str(tmp_path / "i"))


def test_words_of_few_texts_are_held_at_once(spark, monkeypatch):
    df, seen = spark.range(3, numPartitions=1).select("id", F.lit("x").alias("text")), {}
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: seen.update(run=run) or self)
    fulltext.lexemes(df, ["id"], "english")
    n = 1000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([["gardens", "the", f"w{i}", "garden"] for i in range(n)])], ["id", "__t"])
    parts = list(seen["run"](iter([batch])))
    assert max(len(set(p.column("id").to_pylist())) for p in parts) <= 256
    got = sorted((r["id"], r["term"], tuple(r["positions"])) for p in parts for r in p.to_pylist())
    assert got == sorted((i, t, x) for i in range(n) for t, x in (("garden", (1, 4)), (f"w{i}", (3,))))


def test_by_frequency_only_the_best_reach_python(spark, monkeypatch):
    hits = spark.range(50).select(F.lit(1).cast("long").alias("query_id"), F.col("id").alias("chunk_id"), F.array(F.sequence(F.lit(1), (F.col("id") + 1).cast("int")), F.array(F.lit(2))).alias("w"))
    want = search.ranked(fulltext.cover_densities(hits), "tf", 4).select("query_id", "chunk_id", "tf", "density", "rank").collect()
    seen, real = [], type(hits).mapInArrow
    monkeypatch.setattr(type(hits), "mapInArrow", lambda self, *a, **k: seen.append(self.count()) or real(self, *a, **k))
    assert sorted(fulltext.best_hits(hits, "tf", 4).collect()) == sorted(want) and seen == [4]
    assert [r.chunk_id for r in sorted(want, key=lambda r: r.rank)] == [49, 48, 47, 46]
