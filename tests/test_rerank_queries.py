"""Fallback holds for whole queries."""

from docloom.operators import rerank


def test_a_query_has_scores_of_one_provider(spark, monkeypatch):
    monkeypatch.setattr(rerank, "REGISTRY", {})

    def cohere():
        def run(pairs):
            if any(t == "bad" for _, t in pairs):
                raise RuntimeError("no answer")
            return [100.0] * len(pairs)

        return run

    def bge():
        def run(pairs):
            if any(t == "worse" for _, t in pairs):
                raise RuntimeError("no memory")
            return [len(t) / 10 for _, t in pairs]

        return run

    rerank.register("cohere", cohere)
    rerank.register("bge", bge)
    texts = {1: ["good"] * 20, 2: ["good"] * 17 + ["bad", "good", "longer"], 3: ["bad"] + ["fine"] * 11 + ["worse"], 4: ["worse"]}
    rows = [(q, i, "q", t, 0.9 - i / 100, q * 100 + i) for q, ts in texts.items() for i, t in enumerate(ts, 1)]
    df = spark.createDataFrame(rows, "query_id long, pos int, query string, text string, similarity double, extra long").repartition(7)
    got = {q: [] for q in texts}
    for r in rerank.rerank(df, "cohere", 5).orderBy("query_id", "rerank_rank").collect():
        got[r.query_id].append(r)
    assert {q: {r.rerank_provider for r in rs} for q, rs in got.items()} == {1: {"cohere"}, 2: {"bge"}, 3: {"none"}, 4: {"cohere"}}
    assert [r.text for r in got[2]] == ["longer", "good", "good", "good", "good"] and [r.pos for r in got[3]] == [1, 2, 3, 4, 5] and [r.extra for r in got[1]] == [101, 102, 103, 104, 105]
    assert all(r.similarity == r.rerank_score and abs(r.original_similarity - (0.9 - r.pos / 100)) < 1e-12 for rs in got.values() for r in rs)
    assert rerank.rerank(df.limit(0), "cohere").collect() == []
