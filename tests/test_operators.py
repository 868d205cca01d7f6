import hashlib
import io
import random
import zipfile
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import metadata, rules, text, urls, vectors
from docloom.operators import catalog, chunk, cost, embed, evaluate, rerank, search
from docloom.operators import approaches as groups
from docloom.plans import requests
from docloom.plans.config import Config
from docloom.plans.ingest import context_of, document_metadata, ingest, status_log
from docloom.plans.search import compare, resolve_mode, snippet_vectors
from docloom.plans.tools import Library
from docloom.sources import files, web
from docloom.streaming import flows

NOW = datetime(2024, 7, 31, 12)


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


# --- chunks ---


def offsets(*a):
    return [(s, e) for _, s, e, _ in chunk.chunk_text(*a)]


def test_chunks():
    assert chunk.chunk_text("   ") == [] and chunk.chunk_text(None) == []
    assert offsets("a" * 2000) == [(0, 800), (650, 1450), (1300, 2000)]
    assert offsets("a" * 750 + ". " + "b" * 600 + ".", 400, 50) == [(0, 400), (350, 751), (751, 1151), (1101, 1353)]
    assert chunk.chunk_text("Introduction\r\n\r\nThis section")[0][3] == "Introduction"
    assert offsets("a" * 98 + "\n\n\n\n" + "b" * 50, 100, 10) == [(0, 98), (92, 152)]  # a break that straddles the limit is included
    for bad in ((0, 0), (10, -1), (150, 200)):
        with pytest.raises(ValueError):
            chunk.chunk_text("x", *bad)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB .!?\"\n\r\t #", max_size=400), st.integers(2, 60), st.integers(0, 30))
def test_chunk_invariants(source, size, overlap):
    overlap = min(overlap, size - 1)
    found = chunk.chunk_text(source, size, overlap)
    whole = source.replace("\r\n", "\n").replace("\r", "\n").strip(chunk.SPACES)
    covered = set()
    for i, (body, s, e, _) in enumerate(found):
        assert whole[s:e] == body and body and (not i or e > found[i - 1][2])
        covered |= set(range(s, e))
    assert all(c in chunk.SPACES for i, c in enumerate(whole) if i not in covered)


def test_chunk_documents(spark):
    rows = chunk.chunk_documents(spark.createDataFrame([(1, "a" * 2000), (2, None), (3, "Short.")], "doc_id long, text string"), ["doc_id"]).collect()
    assert [(r.doc_id, r.chunk_index, r.start_offset, r.token_count) for r in rows] == [(1, 0, 0, 200), (1, 1, 650, 200), (1, 2, 1300, 175), (3, 0, 0, 2)]


# --- scalar rules ---


def test_text_functions(spark):
    rows = [("  two words ",), ("",), (None,), ("a b﻿",)]
    assert values(spark, rows, "t string", text.word_count(F.col("t")).alias("n")) == [(2,), (0,), (0,), (2,)]
    assert values(spark, [("  a  b ",)], "t string", text.billed_tokens(F.col("t")), text.token_estimate(F.col("t"))) == [(3, 2)]
    pair = ("Use Provider for state management", "Riverpod replaces Provider for testability")
    assert values(spark, [pair], "a string, b string", text.jaccard(text.ascii_tokens(F.col("a")), text.ascii_tokens(F.col("b")))) == [(0.25,)]
    assert text.prefix_query("StatefulWidget lifecycle") == "StatefulWidget:* & lifecycle:*" and text.query_terms("a'b (c)") == ["ab", "c"]
    with pytest.raises(ValueError):
        text.query_terms(" &| ")


def test_vectors(spark):
    rows = [([3.0, 4.0], [6.0, 8.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])]
    got = [r[0] for r in values(spark, rows, "a array<double>, b array<double>", vectors.cosine(F.col("a"), F.col("b")))]
    assert got == [pytest.approx(1.0), 0.0, 0.0, None]
    assert values(spark, [([1.0, float("nan")],), ([],), ([1.0],)], "a array<double>", vectors.valid(F.col("a"))) == [(False,), (False,), (True,)]
    assert values(spark, [("A",)], "t string", F.slice(vectors.character_vector(F.col("t")), 1, 2))[0][0] == [65 / 255, 0.0]


def test_urls(spark):
    cases = {
        "HTTP://A.com:80//x///y/?b=2&a=1&b=1#f": "http://a.com/x/y?a=1&b=2&b=1", "https://a.com": "https://a.com/", "https://a.com:444/": "https://a.com:444/", "ftp://a.com//x": "ftp://a.com//x", "no url": "no url", "http://a.com/x?": "http://a.com/x",
    }
    assert dict(values(spark, [(k,) for k in cases], "u string", "u", urls.normalised(F.col("u")).alias("n"))) == cases
    public = {"http://a.com": True, "http://localhost/": False, "https://8.8.8.8/x": True, "http://127.9.9.9": False, "http://172.32.0.1": True, "http://172.31.0.1": False, "http://169.254.1.1": False, "http://300.1.1.1": False, "http://[::1]/": False, "http://[fd00::1]": False, "http://[2001:db8::1]/": True, "ftp://a.com": False, "x": False}
    assert dict(values(spark, [(k,) for k in public], "u string", "u", urls.is_public(F.col("u")).alias("p"))) == public
    titles = {"https://a.com/b/my-first_page": "my first page", "https://a.com/": "a.com", "/x/some-file_name.tar.gz": "some file name.tar", "https://a.com/a%20b": "a b"}
    assert dict(values(spark, [(k,) for k in titles], "u string", "u", urls.title(F.col("u")).alias("t"))) == titles
    none = F.lit(None).cast("string")
    assert values(spark, [("a.MD",), ("a.xyz",), ("a",)], "u string", urls.content_type(F.col("u"), none), urls.file_extension(none, F.col("u"))) == [("text/markdown", ".MD"), ("application/octet-stream", ".xyz"), ("application/octet-stream", ".bin")]
    assert values(spark, [("attachment; filename=\"a b.pdf\"",), ("inline",), ("filename*=UTF-8''x%20y.md",)], "h string", urls.disposition_name(F.col("h"))) == [("a b.pdf",), (None,), ("x y.md",)]


def test_rules(spark):
    day = lambda s: datetime.strptime(s, "%Y-%m-%d").date()
    rows = [(day("2024-02-01"),), (day("2024-01-31"),), (day("2023-08-01"),), (day("2023-07-30"),), (day("2025-01-01"),), (None,)]
    assert [r[0] for r in values(spark, rows, "d date", rules.recency_weight(F.col("d"), F.lit(NOW.date())))] == [1.0, 0.9, 0.9, 0.7, 1.0, 0.7]
    august = datetime(2024, 8, 31).date()  # six months before the 31st of August runs over into March
    assert [r[0] for r in values(spark, [(day("2024-03-03"),), (day("2024-03-02"),), (day("2023-08-01"),), (day("2022-08-31"),), (day("2022-07-31"),), (None,)], "d date", rules.freshness(F.col("d"), F.lit(august)))] == [1.0, 0.85, 0.85, 0.7, 0.5, 0.7]
    assert [r[0] for r in values(spark, [("official",), ("Official",), ("community",), (None,)], "q string", rules.quality_weight(F.col("q")))] == [1.0, 0.5, 0.6, 0.5]
    routed = [("text", "code", None), ("import x from 'y'", None, None), ("plain", "personal", None), ("plain", None, "Dart"), ("plain", None, None), ("", None, "dart")]
    assert [r[0] for r in values(spark, routed, "t string, c string, l string", rules.provider(F.col("t"), F.col("c"), F.col("l")))] == ["voyage", "voyage", "openai", "voyage", "ollama", "ollama"]
    assert [r[0] for r in values(spark, [("plain",)], "t string", rules.provider(F.col("t"), F.lit(None).cast("string"), F.lit(None).cast("string"), docs="openai"))] == ["openai"]
    quality = [(None, "https://docs.flutter.dev/x", None), (None, "https://github.com/a/b", 5000), (None, "https://x.org", 5000), ("community", "https://dart.dev", 1), (None, None, None)]
    assert [r[0] for r in values(spark, quality, "q string, u string, s int", rules.source_quality(F.col("q"), F.col("u"), F.col("s"), F.lit(None).cast("string")))] == ["official", "verified", "verified", "community", "community"]
    prices = [("openai", None, "embed", 10000), ("voyage", None, "embed", 5000), ("cohere", "rerank-v3.5", "rerank", 1), ("anthropic", "other", "chat", 4000), ("who", None, "x", 9)]
    assert [r[0] for r in values(spark, prices, "p string, m string, o string, t long", F.round(rules.price(F.col("p"), F.col("m"), F.col("o"), F.col("t")), 9))] == [0.0013, 0.0006, 0.001, 0.001, 0.0]
    assert [str(r[0]) for r in values(spark, [(100,), (385,)], "t long", cost.stored_cost(F.lit("openai"), F.lit(None).cast("string"), F.lit("embed"), F.col("t")))] == ["0.0000", "0.0001"]


# --- search ---


def legs(spark):
    v = spark.createDataFrame([(0, 1, 1, 0.9), (0, 2, 2, 0.8)], "query_id int, chunk_id int, rank int, similarity double")
    x = spark.createDataFrame([(0, 2, 1, 1.0), (0, 3, 2, 0.5)], "query_id int, chunk_id int, rank int, score double")
    return v, x


def test_fusion(spark):
    rows = search.fuse(*legs(spark), 10).orderBy("fused_rank").collect()
    assert [(r.chunk_id, round(r.fused_score, 6), r.source) for r in rows] == [(2, 0.016208, "both"), (1, 0.011475, "vector"), (3, 0.004839, "bm25")]
    assert rows[2].vector_score == 0 and rows[1].lexical_score == 0
    assert search.resolve_weights(2, 2) == (0.5, 0.5) and search.resolve_weights(-1, 1) == (0.7, 0.3) and search.resolve_weights(float("nan"), 1) == (0.7, 0.3)


def test_lexical(spark):
    chunks = spark.createDataFrame([(1, "The lifecycle of StatefulWidgets; lifecycle"), (2, "statefulwidget lifecycles"), (3, "lifecycle only"), (4, None)], "chunk_id int, text string")
    rows = search.lexical_search(chunks, "StatefulWidget lifecycle").collect()
    assert [(r.chunk_id, r.tf, round(r.score, 3), r["rank"]) for r in rows] == [(1, 3, 1.0, 1), (2, 2, 0.667, 2)]
    ranked = search.max_normalised(spark.createDataFrame([(1, 0.8), (2, 0.4)], "chunk_id int, raw double"), "raw").collect()
    assert [(r.score, r["rank"]) for r in ranked] == [(1.0, 1), (0.5, 2)]
    assert [r.chunk_id for r in search.cover_density_search(chunks, "StatefulWidget lifecycle").collect()] == [1, 2]
    with pytest.raises(ValueError):
        search.hybrid(chunks, "!", [1.0])


def test_cover_density():
    assert search.cover_density([[1], [2]]) == pytest.approx(0.1) and search.cover_density([[1], [4]]) == pytest.approx(0.1 / 3)
    assert search.cover_density([[1, 5], [2]]) == pytest.approx(0.1 + 0.1 / 3) and search.cover_density([[1], []]) == 0 and search.cover_density([[3, 9]]) == pytest.approx(0.2)


def test_vector_search(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [-1.0, 0.0]), (6, [1.0])]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    assert [r.chunk_id for r in search.vector_search(df, [1.0, 0.0]).collect()] == [1, 2]
    got = search.vector_search_batch(df, df.withColumnRenamed("chunk_id", "query_id"), 2, -1.0, exclude_self=True).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got if r.query_id in (1, 5)] == [(1, 2), (1, 4), (5, 4), (5, 2)]
    for bad in (0, -1, float("inf")):
        with pytest.raises(ValueError):
            search.vector_search(df, [1.0, 0.0], bad)


def test_trust_and_citation(spark):
    df = spark.createDataFrame([(1, 0.5, 0.4, "official", datetime(2024, 7, 1), {"page": "3", "section": "S"}), (2, float("nan"), 0.2, None, None, {})], "chunk_id int, similarity double, fused_score double, q string, v timestamp, metadata map<string,string>")
    a, b = search.cited(search.trusted(df, F.col("q"), F.col("v"), F.lit(NOW))).collect()
    assert (a.similarity, a.citation_page, a.citation_section) == (0.5, "3", "S") and b.similarity == 0 and b.fused_score == pytest.approx(0.2 * 0.35) and b.citation_section is None


# --- rerank ---


def candidates(spark):
    return spark.createDataFrame([(0, 1, "q", "Doc A", 0.3), (0, 2, "q", "Doc B", 0.4), (0, 3, "q", "Doc C", 0.1)], "query_id int, pos int, query string, text string, similarity double")


def test_rerank(spark, monkeypatch):
    monkeypatch.setattr(rerank, "REGISTRY", {})
    rerank.register("bge", lambda: lambda pairs: [{"Doc A": 0.2, "Doc B": [{"score": 0.5}], "Doc C": {"value": 0.9}}[t] for _, t in pairs])

    def broken():
        raise RuntimeError

    rerank.register("cohere", lambda: lambda pairs: broken())
    for provider in ("bge", "cohere"):  # a broken one hands over
        rows = rerank.rerank(candidates(spark), provider).orderBy("rerank_rank").collect()
        assert [(r.text, r.similarity, r.rerank_provider) for r in rows] == [("Doc C", 0.9, "bge"), ("Doc B", 0.5, "bge"), ("Doc A", 0.2, "bge")] and rows[0].original_similarity == 0.1
    assert [r.text for r in rerank.rerank(candidates(spark), "none", 2).orderBy("rerank_rank").collect()] == ["Doc A", "Doc B"]
    assert rerank.window_sizes() == (50, 50, 15) and rerank.window_sizes(5, 3) == (3, 5, 5) and rerank.window_sizes(60, 99, 100) == (50, 60, 60)
    assert rerank.choose_provider("cohere", key=False) == "bge" and rerank.choose_provider(None, "bge", "cohere") == "bge" and rerank.choose_provider() == "none"
    assert [rerank.number(x) for x in (None, "x", float("nan"), [], [2], {"score": "3"})] == [0, 0, 0, 0, 2, 3]


def test_rerank_by_index(spark, monkeypatch):
    monkeypatch.setattr(rerank, "REGISTRY", {})
    rerank.register("bge", lambda: lambda pairs: [{"index": 2, "relevance_score": 0.9}, {"index": 0}, {"index": 7, "score": 1}, {"index": None, "score": 1}])
    rows = rerank.rerank(candidates(spark).coalesce(1), "bge").orderBy("rerank_rank").collect()
    assert [(r.text, r.rerank_score) for r in rows] == [("Doc C", 0.9), ("Doc A", 0.0)]  # the one without an entry goes


# --- catalogue ---


def test_catalogue_writes(spark):
    docs = spark.createDataFrame([("a", "c1", None, "x", {"k": "1"}, None), ("b", "c2", "/p", "y", None, NOW)], "id string, collection_id string, file_path string, status string, metadata map<string,string>, processed_at timestamp").withColumns({"error_message": F.lit("e"), "updated_at": F.lit(NOW)})
    is_a = F.col("id") == "a"
    row = lambda df: df.filter(is_a).first()
    assert row(catalog.set_status(docs, is_a, "complete", F.lit(NOW), file_path="/q")).asDict().items() >= {"status": "complete", "file_path": "/q", "processed_at": NOW, "error_message": None}.items()
    assert row(catalog.set_status(docs, is_a, "error", F.lit(NOW), "bad")).processed_at is None
    assert row(catalog.merge_metadata(docs, is_a, F.create_map(F.lit("k"), F.lit("2"), F.lit("n"), F.lit("3")))).metadata == {"k": "2", "n": "3"}
    assert [r.status for r in catalog.restart(docs, F.lit(True), F.lit(NOW)).orderBy("id").collect()] == ["x", "pending"]
    chunks = spark.createDataFrame([(1, "a", 0, "old"), (2, "b", 0, "keep")], "id long, doc_id string, chunk_index int, text string")
    new = spark.createDataFrame([(9, "a", 0, "new"), (8, "a", 1, "more")], chunks.schema)
    assert sorted(map(tuple, catalog.upsert(chunks, new, ["doc_id", "chunk_index"], ["id"]).collect())) == [(1, "a", 0, "new"), (2, "b", 0, "keep"), (8, "a", 1, "more")]
    cols, ids = spark.createDataFrame([("c1",), ("c2",)], "id string"), spark.createDataFrame([("c1",)], "id string")
    a, b, c = catalog.delete_collection(cols, docs, chunks, ids)
    assert [x.count() for x in (a, b, c)] == [1, 1, 1]
    with pytest.raises(ValueError):
        catalog.delete_collection(cols, docs, chunks, ids, spark.createDataFrame([("c1",)], "collection_id string"))
    with pytest.raises(ValueError):
        catalog.set_status(docs, is_a, "nowhere", F.lit(NOW))


# --- approaches ---


def test_clusters():
    a, b = np.array([1.0, 0, 0.1]), np.array([0, 1.0, 0.1])
    own, _ = groups.cluster([a, b, a + 0.01, b + 0.01, a, b])
    assert own == [0, 1, 0, 1, 0, 1] and groups.cluster([a])[0] == [0]


def results(spark):
    v = [([1.0, 0.0, 0.1], "Firebase Auth Guide", "Use Firebase for auth with email", "official"), ([0.0, 1.0, 0.1], "Supabase Auth Guide", "Use Supabase for auth with magic links", "verified")]
    rows = [(0, i + 1, *v[i % 2], None, None, None, None, None) for i in range(6)]
    return spark.createDataFrame(rows, "query_id long, pos int, embedding array<double>, title string, text string, quality string, url string, verified date, published date, topic string, method string")


def test_compare(spark):
    judge = lambda: lambda a, b: 'so: {"contradiction": true, "severity": "high", "difference": "d", "confidence": 7}'
    out = compare(results(spark), "auth", NOW, Config(comparison=True, contradictions=True), judge)
    assert [(r.approach, r.method, r.topic, len(r.sources)) for r in out["approaches"].orderBy("approach").collect()] == [(0, "Firebase Auth Guide", "Firebase Auth Guide", 3), (1, "Supabase Auth Guide", "Supabase Auth Guide", 3)]
    (c,) = out["conflicts"].collect()
    assert (c.severity, c.confidence, c.a_title) == ("high", 1.0, "Firebase Auth Guide")
    assert out["recommended"].first().method == "Firebase Auth Guide"
    assert compare(results(spark).limit(0), "x", NOW, Config(comparison=True))["recommended"].count() == 0
    with pytest.raises(PermissionError):
        compare(results(spark), "x", NOW, Config())


def test_penalty_moves_the_recommendation(spark):
    found = spark.createDataFrame([(0, 0, 0.9, [("F", None)]), (0, 1, 0.8, [("S", None)])], "query_id int, approach int, consensus_score double, sources array<struct<title string, url string>>")
    conflicts = spark.createDataFrame([(0, 1, "high", "F", None, "X", None)], "query_id int, pair_rank int, severity string, a_title string, a_url string, b_title string, b_url string")
    assert groups.recommended(found, conflicts).first().approach == 1 and groups.recommended(found, conflicts.limit(0)).first().approach == 0


def test_verdicts():
    assert groups.parse_verdict('{"contradiction": true}') == {"severity": "medium", "difference": "", "recommendation": "", "confidence": 0.6}
    assert [groups.parse_verdict(x) for x in (None, "no", "{bad}", '{"contradiction": "true"}', "[1]")] == [None] * 5


# --- cost ---


def test_alerts(spark):
    t = datetime(2024, 7, 1)
    alerts = spark.createDataFrame([("warning", "monthly", t)], "alert_type string, period string, triggered_at timestamp")
    new = spark.createDataFrame([("warning", "monthly", t + timedelta(hours=23)), ("warning", "monthly", t + timedelta(hours=24)), ("limit_reached", "monthly", t)], alerts.schema)
    assert sorted((r.alert_type, r.triggered_at) for r in cost.new_alerts(new, alerts).collect()) == [("limit_reached", t), ("warning", t + timedelta(hours=24))]
    log = spark.createDataFrame([(i, t + timedelta(hours=i), 1.0) for i in range(60)], "usage_id long, created_at timestamp, cost_usd double")
    got = [(r.alert_type, r.usage_id) for r in cost.replay_alerts(log, 10).collect()]
    assert sorted(got) == [("limit_reached", 9), ("limit_reached", 33), ("limit_reached", 57), ("warning", 8)]
    assert cost.recent_alerts(new, 0).count() == 1 and cost.recent_alerts(new, 500).count() == 3
    assert cost.valid_budget(None) == 10 and cost.valid_budget("x") is None and cost.valid_budget("12.5") == 12.5
    states = [r.state for s in (8.5, 10.5, 5.0, 8.0) for r in cost.summary(spark.createDataFrame([(s,)], "spend double")).collect()]
    assert states == ["warning", "limit_reached", None, None]


def test_alerts_of_random_logs(spark):
    """Against a plain walk over the log; requests lie so that an hour's first and last are not enough."""
    rng = random.Random(3)
    for budget in (5, 40):
        log = sorted((datetime(2024, 1, 25) + timedelta(minutes=rng.randrange(60 * 24 * 12)), i, round(rng.random(), 4)) for i in range(400))
        spent, last, want = {}, {}, []
        for t, i, c in log:
            spent[t.month] = round(spent.get(t.month, 0) + c, 4)
            kind = "limit_reached" if spent[t.month] >= budget else "warning" if spent[t.month] > 0.8 * budget else None
            if kind and (kind not in last or t - last[kind] >= timedelta(hours=24)):
                last[kind] = t
                want.append((kind, t, i, spent[t.month]))
        df = spark.createDataFrame([(i, t, Decimal(str(c))) for t, i, c in log], "usage_id long, created_at timestamp, cost_usd decimal(10,4)")
        assert sorted(map(tuple, cost.replay_alerts(df, budget).collect())) == sorted(want)
        assert cost.replay_alerts(df.limit(0), budget).count() == 0
    day = datetime(2024, 1, 1)
    times = [day + timedelta(hours=10, minutes=30), day + timedelta(hours=34, minutes=5), day + timedelta(hours=34, minutes=40), day + timedelta(hours=34, minutes=55)]
    df = spark.createDataFrame([(i + 1, t, 9.0) for i, t in enumerate(times)], "usage_id long, created_at timestamp, cost_usd double").withColumn("cost_usd", F.when(F.col("usage_id") == 1, 9.0).otherwise(0.0))
    assert [(r.usage_id, r.triggered_at) for r in cost.replay_alerts(df, 10).orderBy("triggered_at").collect()] == [(1, times[0]), (3, times[2])]


# --- evaluation ---


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, True), (3, 1, False)], "query_id int, rank int, relevant boolean")
    assert {r.query_id: r.p_at_5 for r in evaluate.precision_at(ranked, 5).collect()} == {1: 0.5, 2: 1.0, 3: 0.0}
    assert evaluate.mean_reciprocal_rank(ranked).first().mrr == 0.5
    x = spark.createDataFrame([(float(i),) for i in range(1, 12)] + [(None,), (1.0,)], "v double")
    parts = evaluate.topic_index(spark.createDataFrame([(i, ["a"] + ["b"] * (i % 2)) for i in range(50)], "id int, topics array<string>"), 4).collect()
    assert {t: sorted(i for r in parts if r.topic == t for i in r.ids) for t in "ab"} == {"a": list(range(50)), "b": list(range(1, 50, 2))} and len(parts) > 2
    assert tuple(evaluate.lower_percentiles(x, "v").first()) == (5.0, 10.0, 10.0) and tuple(evaluate.lower_percentiles(x.limit(0), "v").first()) == (0, 0, 0)


# --- sources, ingest, tools ---


def docx(*paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a-b.md").write_text("# Head\n\n* **bold** [link](u)\n")
    (tmp_path / "c.txt").write_text("plain text")
    (tmp_path / "d.docx").write_bytes(docx("one", "two"))
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    found = {r.title: r for r in files.extract(files.read_files(spark, str(tmp_path)), ["path", "title"]).collect()}
    assert found["a b"].text.strip() == "Head\n\nbold link" and found["a b"].word_count == 5
    assert found["c"].text == "plain text" and found["d"].text == "one\n\ntwo" and found["d"].word_count == 2
    assert found["e"].text is None and "pdf" in found["e"].error
    files.PARSERS["pdf"] = lambda content: (f"{len(content)} bytes", 2)
    try:
        paged = {r.title: r for r in files.extract(files.read_files(spark, str(tmp_path), "*.pdf"), ["title"]).collect()}
    finally:
        del files.PARSERS["pdf"]
    assert (paged["e"].text, paged["e"].page_count, paged["e"].word_count) == ("4 bytes", 2, 2)
    assert files.storage_path("/s", "c-1", "d1", ".md") == "/s/c-1/d1.md"
    with pytest.raises(ValueError):
        files.storage_path("/s", "../c", "d", ".md")
    assert not files.delete_file(spark, str(tmp_path / "none"))


def test_stored_documents_and_databases(spark, tmp_path):
    row = lambda *r: spark.createDataFrame([r], "collection string, doc string, extension string, content binary")
    files.store_documents(row("c-1", "d1", ".md", b"text"), f"{tmp_path}/files")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/files").select("path", "doc").collect()] == [("c-1/d1.md", "d1")]
    for bad in (("../c", "d", ".md"), ("c", "d/e", ".md"), ("c", "d", "md"), (None, "d", ".md")):
        with pytest.raises(Exception, match="unsafe"):
            files.store_documents(row(*bad, b""), f"{tmp_path}/files")
    url = "jdbc:derby:memory:docloom;create=true"
    spark.range(5).withColumnRenamed("id", "n").write.jdbc(url, "numbers", "overwrite", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    got = files.read_jdbc(spark, url, "SELECT * FROM numbers", driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert sorted(r[0] for r in got.filter("n > 2").collect()) == [3, 4]


def test_typed_metadata(spark):
    rows = ['{"page": 3, "heading": "h"}', '{"page": "iv", "section": "s"}', '{"page": [1], "heading": 5, "section": "s"}', '{"page": true, "heading": null, "section": "s"}', "no json", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, metadata string").withColumn("similarity", F.lit(0.5))
    got = [(r.citation_page, r.citation_section) for r in search.cited(df).orderBy("i").collect()]
    assert got == [("3", "h"), ("iv", "s"), (None, None), (None, "s"), (None, None), (None, None)]
    kinds = [r[0] for r in df.orderBy("i").select(metadata.json_type(F.col("metadata"), "page")).collect()]
    assert kinds == ["number", "string", "array", "boolean", None, None]
    merged = spark.createDataFrame([('{"a": 1, "b": "x"}', '{"b": "y"}')], "l string, r string").select(metadata.json_merged(F.col("l"), F.col("r"))).first()[0]
    assert merged == {"a": "1", "b": "y"}


def test_replace_and_store(spark, tmp_path):
    path = f"{tmp_path}/t"
    files.append(spark.range(3), path)
    files.replace(spark.read.parquet(path).filter("id > 0"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
    chunks = f"{tmp_path}/c"
    row = lambda *r: spark.createDataFrame(list(r), "doc_id string, chunk_index int, text string")
    files.store_chunks(row(("a", 0, "1"), ("a", 1, "2"), ("b", 0, "3")), chunks, 4)
    for _ in "12":  # writing again leaves the same rows
        files.store_chunks(row(("a", 0, "new"), ("c", 0, "4")), chunks, 4)
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(chunks).collect()) == [("a", "new"), ("b", "3"), ("c", "4")]


def test_web(spark):
    assert web.to_markdown("<body><nav>x</nav><main><h2>Hi <b>you</b></h2><ul><li>one<li>two</ul><pre>a\n b</pre></main>") == "## Hi **you**\n\n-   one\n\n-   two\n\n```\na\n b\n```"
    assert web.to_markdown("<main> </main><article>text</article>") == "text" and web.to_markdown(None) == ""
    page = lambda u, *links: (u, "".join(f'<a class="x" href="{x}">t</a>' for x in links))
    pages = spark.createDataFrame([page("http://a.com/", "/b", "http://a.com/c#f", "http://b.com/", "#x"), page("http://a.com/b", "/d"), page("http://a.com/c/", "/missing"), page("http://a.com/d")], "url string, html string")
    edges = web.links(pages)
    assert sorted(map(tuple, edges.collect())) == [("http://a.com/", "http://a.com/b"), ("http://a.com/", "http://a.com/c"), ("http://a.com/b", "http://a.com/d"), ("http://a.com/c", "http://a.com/missing")]
    assert web.crawl(pages, edges, "http://a.com/#top") == [("http://a.com/", 0), ("http://a.com/b", 1), ("http://a.com/c", 1), ("http://a.com/d", 2)]
    chain = spark.createDataFrame([(f"http://c.com/{i:03d}", "") for i in range(60)], "url string, html string")
    steps = spark.createDataFrame([(f"http://c.com/{i:03d}", f"http://c.com/{i + 1:03d}") for i in range(59)], "src string, dst string")
    assert web.crawl(chain, steps, "http://c.com/000", most=55)[-1] == ("http://c.com/054", 54)  # a chain of any length
    assert len(web.crawl(pages, edges, "http://a.com/", most=2)) == 2 and web.crawl(pages, edges, "http://z.com/") == []


def test_ingest(spark):
    rows = [("a", "Some text. " * 200, None, {"language": "dart"}, None), ("b", "", None, None, None), ("c", None, "no extractor", None, None), ("d", "import x", None, None, "/x.ts")]
    docs = spark.createDataFrame(rows, "id string, text string, error string, metadata map<string,string>, file_path string").withColumn("content_type", F.lit("text/plain"))
    made, outcomes = ingest(docs)
    kinds = {(r.doc_id, r.embedding_provider, r.embedding_dimensions) for r in made.collect()}
    assert kinds == {("a", "voyage", 1024), ("d", "voyage", 1024)}
    assert {r.id: r.status for r in outcomes.collect()} == {"a": "complete", "b": "complete", "c": "error", "d": "complete"}
    log = {}
    for r in status_log(outcomes, made, NOW).orderBy("step").collect():
        log.setdefault(r.id, []).append(r.status)
    assert log["a"] == ["extracting", "chunking", "embedding", "complete"] and log["b"] == ["extracting", "chunking", "complete"] and log["c"] == ["extracting", "error"]
    assert [r[0] for r in docs.orderBy("id").select(context_of(F.col("metadata"), F.col("file_path"), F.col("content_type"))[0]).collect()] == ["docs", "docs", "docs", "code"]
    full = document_metadata(docs.withColumn("source_url", F.lit("https://github.com/x")), default_tags=("t",)).filter("id = 'a'").first()
    assert full.metadata == {"language": "dart", "source_quality": "verified", "doc_type": "repo", "tags": "t"}


def test_embedding(spark, monkeypatch):
    monkeypatch.setattr(embed, "REGISTRY", dict(embed.REGISTRY))

    def broken(texts):
        raise RuntimeError

    embed.register("openai", lambda: broken)
    df = spark.createDataFrame([(1, "one two", "openai"), (2, "", None)], "id int, text string, provider string")
    rows = {r.id: r for r in embed.embed(df, ["id"], delay=0).collect()}
    assert rows[1].used_fallback and rows[1].embedding_provider == "ollama" and len(rows[1].embedding) == 768 and not rows[2].used_fallback
    texts = spark.createDataFrame([(1, "A" * 700)], "id int, text string")
    assert len(snippet_vectors(texts, "openai").first().embedding) == 768
    embed.register("ollama", lambda: broken)
    monkeypatch.setattr(embed, "RETRIES", 0)
    assert snippet_vectors(texts, "openai").first().embedding == [65 / 255] * 16
    tries = []
    with pytest.raises(RuntimeError):
        embed.with_retries(lambda t: tries.append(1) or broken(t), ["x"], delay=0)
    assert len(tries) == 4
    for bad in ([], [float("nan")], [[1.0]]):
        with pytest.raises(ValueError):
            embed.checked(bad)
    with pytest.raises(ValueError):
        embed.embed(df, ["id"], batch=0)


def test_embedding_gives_vectors_back_in_small_parts(spark, monkeypatch):
    rows = spark.range(3000, numPartitions=1).select("id", F.concat(F.lit("text "), "id").alias("text"), F.lit("voyage").alias("provider"))
    seen = {}
    monkeypatch.setattr(type(rows), "mapInPandas", lambda self, run, schema: seen.update(run=run) or self)
    embed.embed(rows, ["id"])
    batch = pd.DataFrame({"id": range(3000), "__text": [f"text {i} text Word" for i in range(3000)], "__provider": ["voyage"] * 3000})
    parts = list(seen["run"](iter([batch])))
    assert max(map(len, parts)) <= 500 and [i for p in parts for i in p["id"]] == list(range(3000))
    for i in (0, 2999):
        v = np.zeros(1024)
        for w in ("text", str(i), "text", "word"):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % 1024] += 1 if h >> 63 else -1
        got = parts[0 if i == 0 else -1]["embedding"].iloc[0 if i == 0 else -1]
        assert np.array_equal(np.asarray(got, np.float32), (v / np.sqrt(v @ v)).astype(np.float32))


def test_tools(spark, tmp_path):
    lib = Library(spark, str(tmp_path), Config(as_of=NOW, budget=0.0005, trust_scoring=True))
    c = lib.create_collection("Guides")
    a = lib.add_document(c, "Auth", "Authentication with magic links. " * 40, source_url="https://github.com/x")
    lib.add_document(c, "State", "State management with providers. " * 40)
    assert [(r.name, r.doc_count) for r in lib.list_collections().collect()] == [("Guides", 2)]
    assert {r.title: r.chunk_count > 0 for r in lib.list_documents(c).collect()} == {"Auth": True, "State": True}
    assert lib.get_document_status(a).first().status == "complete" and lib.summarize_document(a).startswith("Authentication")
    for mode in ("vector", "hybrid"):
        top = lib.search_rag("authentication magic links", c, mode=mode, min_similarity=0.0).first()
        assert top.doc_title == "Auth" and top["rank"] == 1
    assert lib.search_rag("magic links", reranking=True, min_similarity=0.0).first().rerank_provider == "none"
    for bad in ({"query": " "}, {"query": "x", "top": 51}, {"query": "x", "min_similarity": 2}):
        with pytest.raises(ValueError):
            lib.search_rag(**bad)
    lib.track("openai", "embed", 10_000, collection=c)
    lib.track("openai", "embed", 10_000)
    lib.track("ollama", "embed", 10_000)
    assert lib.cost_summary().first().state == "limit_reached" and lib.recent_alerts().count() == 1 and lib.cost_breakdown().first().request_count == 2
    pages = spark.createDataFrame([("https://a.org/my-page", "<main>Web text</main>")], "url string, html string")
    w = lib.fetch_web_content(pages, "https://a.org/my-page", c)
    assert lib.get_document_status(w).first().title == "my page"
    with pytest.raises(ValueError):
        lib.fetch_web_content(pages, "http://localhost/", c)
    lib.delete_document(a)
    assert lib.list_documents(c).count() == 2
    with pytest.raises(LookupError):
        lib.delete_document(a)
    with pytest.raises(ValueError):
        lib.delete_collection(c)  # usage rows refer to it
    assert resolve_mode(None, Config(search_mode="hybrid"), False) == "hybrid" and resolve_mode("vector", Config(), True) == "hybrid"
    assert Config.from_env({"ENABLE_COMPARISON": "true", "HYBRID_VECTOR_WEIGHT": "0.5", "MONTHLY_BUDGET_USD": "x"}) == Config(comparison=True, vector_weight=0.5, budget=None)


def test_requests(spark, tmp_path):
    c = "123e4567-e89b-12d3-a456-426614174000"
    assert requests.search_request({"query": "q", "collection_id": c, "topK": 7, "top_k": 3, "minSimilarity": 0.2}) == {"query": "q", "collection_id": c, "top_k": 7, "min_similarity": 0.2}
    bad = ({"query": ""}, {"top_k": 0}, {"topK": 51}, {"top_k": 1.5}, {"top_k": True}, {"min_similarity": 1.1}, {"search_mode": "x"}, {"rerank": 1}, {"rerankProvider": "y"}, {"collectionId": "z"}, {"other": 1})
    for more in bad:
        with pytest.raises(ValueError, match=next(iter(more))):
            requests.search_request({"query": "q", "collection_id": c} | more)
    with pytest.raises(ValueError, match="collection_id: required"):
        requests.search_request({"query": "q"})
    with pytest.raises(ValueError, match="topK: unknown"):
        requests.compare_request({"query": "q", "collection_id": c, "topK": 3})
    lib = Library(spark, str(tmp_path), Config(as_of=NOW, comparison=True))
    c = lib.create_collection("Guides")
    lib.add_document(c, "Auth", "Authentication with magic links. " * 40, metadata={"approach": "links by mail"})
    assert lib.search({"query": "authentication links", "collectionId": c, "min_similarity": 0, "topK": 2}).first().doc_title == "Auth"
    out = lib.compare({"query": "authentication links", "collection_id": c, "top_k": 4})
    assert out["approaches"].first().method == "links by mail" and out["recommended"].count() == 1 and out["conflicts"].count() == 0


# --- streams ---


def test_streams(spark, tmp_path):
    t = datetime(2024, 7, 1)
    rows = [("warning", t + timedelta(hours=h)) for h in (0, 5, 24, 30, 48)]
    spark.createDataFrame(rows, "alert_type string, triggered_at timestamp").write.parquet(f"{tmp_path}/alerts")
    stream = spark.readStream.schema("alert_type string, triggered_at timestamp").parquet(f"{tmp_path}/alerts")
    q = flows.silenced(stream).writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/s").start()
    q.awaitTermination(120)
    assert sorted(r.triggered_at for r in spark.table("kept").collect()) == [t, t + timedelta(hours=24), t + timedelta(hours=48)]
    docs = spark.createDataFrame([("a", "Some text. " * 100, None, None, None, "text/plain")], "id string, text string, error string, metadata map<string,string>, file_path string, content_type string")
    docs.write.parquet(f"{tmp_path}/docs")
    flows.ingest_stream(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/docs"), f"{tmp_path}/chunks", f"{tmp_path}/i").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/chunks").count() == 2
