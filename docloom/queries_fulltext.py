"""Registered queries of full-text search by language, with SQL that stems and ranks on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .functions.stems import ENGLISH_STOPS
from .operators import fulltext
from .queries import _CHUNKS, _TOKENS, TERMS, chunks, query, vector_chunks
from .session import load, scratch

_STOP = "(" + ", ".join(f"'{w}'" for w in ENGLISH_STOPS.split()) + ")"


def _cases(suffix: str, pairs: str) -> str:
    return "CASE " + suffix + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in (p.split(":") for p in pairs.split())) + " END"


def stem_sql(tokens: str) -> str:
    """CTEs up to stems (token, term) for the English stemmer over the table `tokens` (token), one step after another."""
    cut = lambda n: f"substr(w, 1, length(w) - {n})"
    region = lambda x, rest: f"coalesce(nullif(length(regexp_extract({x}, '^.*?[aeiouy][^aeiouy]')), 0), {rest})"
    short = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
    two = "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble fulli:ful lessli:less ogi:og li:"
    three = "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:"
    four = "al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ism|ate|iti|ous|ive|ize|ion"
    whole = "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes"
    ends = lambda pairs: "(" + "|".join(p.split(":")[0] for p in pairs.split()) + ")$"
    steps = [
        f"y0 AS (SELECT token, regexp_replace(regexp_replace(token, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {tokens})",
        f"y1 AS (SELECT *, CASE WHEN w LIKE 'gener%' OR w LIKE 'arsen%' THEN 5 WHEN w LIKE 'commun%' THEN 6 ELSE {region('w', 'length(w)')} END AS p FROM y0)",
        f"y2 AS (SELECT *, p + {region('substr(w, p + 1)', 'length(w) - p')} AS q FROM y1)",
        f"a1 AS (SELECT token, p, q, CASE WHEN w LIKE '%sses' THEN {cut(2)} WHEN w LIKE '%ied' OR w LIKE '%ies' THEN CASE WHEN length(w) > 4 THEN {cut(2)} ELSE {cut(1)} END"
        f" WHEN w LIKE '%s' AND w NOT LIKE '%us' AND w NOT LIKE '%ss' AND regexp_matches({cut(2)}, '[aeiouy]') THEN {cut(1)} ELSE w END AS w FROM y2)",
        "a2 AS (SELECT *, regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$') AS e FROM a1)",
        "a3 AS (SELECT *, substr(w, 1, length(w) - length(e)) AS b FROM a2)",
        f"a4 AS (SELECT token, p, q, w AS early, CASE WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(b) >= p THEN b || 'ee' ELSE w END WHEN e = '' OR NOT regexp_matches(b, '[aeiouy]') THEN w WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e'"
        f" WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN substr(b, 1, length(b) - 1) WHEN length(b) <= p AND regexp_matches(b, '{short}') THEN b || 'e' ELSE b END AS w FROM a3)",
        f"a5 AS (SELECT token, p, q, early, CASE WHEN length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$') THEN {cut(1)} || 'i' ELSE w END AS w FROM a4)",
        f"b1 AS (SELECT *, regexp_extract(w, '{ends(two)}') AS e FROM a5)",
        "b2 AS (SELECT *, substr(w, 1, length(w) - length(e)) AS b FROM b1)",
        f"b3 AS (SELECT token, p, q, early, CASE WHEN e <> '' AND length(b) >= p AND (e <> 'ogi' OR b LIKE '%l') AND (e <> 'li' OR regexp_matches(b, '[cdeghkmnrt]$')) THEN b || {_cases('e', two)} ELSE w END AS w FROM b2)",
        f"c1 AS (SELECT *, regexp_extract(w, '{ends(three)}') AS e FROM b3)",
        f"c2 AS (SELECT token, p, q, early, CASE WHEN e <> '' AND length(w) - length(e) >= CASE e WHEN 'ative' THEN q ELSE p END THEN substr(w, 1, length(w) - length(e)) || {_cases('e', three)} ELSE w END AS w FROM c1)",
        f"d1 AS (SELECT *, regexp_extract(w, '({four})$') AS e FROM c2)",
        "d2 AS (SELECT token, p, q, early, CASE WHEN e <> '' AND length(w) - length(e) >= q AND (e <> 'ion' OR regexp_matches(w, '[st]ion$')) THEN substr(w, 1, length(w) - length(e)) ELSE w END AS w FROM d1)",
        f"d3 AS (SELECT token, early, CASE WHEN w LIKE '%e' THEN CASE WHEN length(w) - 1 >= q OR length(w) - 1 >= p AND NOT regexp_matches({cut(1)}, '{short}') THEN {cut(1)} ELSE w END WHEN w LIKE '%ll' AND length(w) - 1 >= q THEN {cut(1)} ELSE w END AS w FROM d2)",
        f"stems AS MATERIALIZED (SELECT token, coalesce({_cases('token', whole)}, CASE WHEN length(token) < 3 THEN token WHEN early IN ('inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed', 'succeed') THEN early ELSE replace(w, 'Y', 'y') END) AS term FROM d3)",
    ]
    return ", ".join(steps)


def _postings(table: str, id_: str, more: str = "") -> str:
    """CTEs up to post (id, term, pos) of the English stems of a table's texts, stop words left out."""
    return (
        f"tok AS MATERIALIZED (SELECT {id_} AS id{more}, unnest({_TOKENS}) AS token, generate_subscripts({_TOKENS}, 1) AS pos FROM {table}), words AS (SELECT DISTINCT token FROM tok UNION SELECT token FROM asked),"
        f" {stem_sql('words')}, post AS MATERIALIZED (SELECT id{more}, term, pos FROM tok JOIN stems USING (token) WHERE token NOT IN {_STOP}),"
        f" need AS MATERIALIZED (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY term) AS no, term AS prefix FROM (SELECT DISTINCT query_id, term FROM asked JOIN stems USING (token) WHERE token NOT IN {_STOP}))"
    )


_HITS = "hits AS MATERIALIZED (SELECT DISTINCT query_id, id, no, pos FROM (SELECT query_id, no, t.term FROM need JOIN (SELECT DISTINCT term FROM post) t ON starts_with(t.term, prefix)) m JOIN post USING (term))"
_BOTH = "full_hits AS (SELECT query_id, id, tf FROM (SELECT query_id, id, count(DISTINCT pos) AS tf, count(DISTINCT no) AS have FROM hits GROUP BY ALL) JOIN (SELECT query_id, count(*) AS have FROM need GROUP BY ALL) USING (query_id, have))"
#: Two words from the middle of each benchmark passage.
_ASKED = "asked AS MATERIALIZED (SELECT item_id AS query_id, unnest(t[3:4]) AS token FROM (SELECT item_id, {0} AS t FROM benchmark))"


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    words = F.slice(text.terms(F.col("text")), 3, 2)
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"))


@query(f"WITH words AS (SELECT DISTINCT unnest({_TOKENS}) AS token FROM documents), {stem_sql('words')} SELECT token, term FROM stems WHERE token NOT IN {_STOP}")
def stemmed_words(spark, sf):
    """Every distinct word of the documents with its English stem."""
    words = load(spark, sf, "documents").select(F.explode(text.terms(F.col("text"))).alias("token")).distinct()
    return fulltext.lexemes(words, ["token"], "english", "token").select("token", "term")


@query(
    f"WITH {_ASKED.format(_TOKENS)}, {_postings(_CHUNKS, 'chunk_id')}, {_HITS}, {_BOTH},"
    " r AS (SELECT query_id, id AS chunk_id, tf, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tf DESC, id) AS INTEGER) AS rank FROM full_hits) SELECT query_id, chunk_id, tf, tf * 1.0::DOUBLE / max(tf) OVER (PARTITION BY query_id) AS score, rank FROM r WHERE rank <= 30"
)
def stemmed_search(spark, sf):
    """Many queries at once over a stored index of English stems."""
    return fulltext.stem_search(chunks(spark, sf), _queries(spark, sf), "english", by="tf").select("query_id", "chunk_id", "tf", "score", "rank")


_PAIR = "thing ering"


@query(
    f"WITH asked AS (SELECT 0 AS query_id, unnest(['thing', 'ering']) AS token), {_postings(_CHUNKS, 'chunk_id')}, {_HITS},"
    " n AS (SELECT id, no, pos, lead(no) OVER w AS next, lead(pos) OVER w AS next_pos FROM hits WHERE id IN (SELECT id FROM hits GROUP BY id HAVING count(DISTINCT no) = 2) WINDOW w AS (PARTITION BY id ORDER BY pos)),"
    " d AS (SELECT id AS chunk_id, round(sum(CASE WHEN no <> next THEN 0.1::DOUBLE / (next_pos - pos) ELSE 0 END), 9) AS density FROM n GROUP BY id) SELECT chunk_id, density FROM d"
)
def stemmed_density(spark, sf):
    """Cover density over positions that count stop words: of two stems the minimal covers are neighbouring matches."""
    asked = spark.createDataFrame([(0, _PAIR)], "query_id long, query string")
    return fulltext.stem_search(chunks(spark, sf), asked, "english", 100_000_000).select("chunk_id", F.round("density", 9).alias("density"))


@query(f"WITH m AS (SELECT chunk_id, CAST(len(list_filter(t, lambda w: starts_with(w, 'the') OR starts_with(w, 'an'))) AS BIGINT) AS tf FROM (SELECT chunk_id, {_TOKENS} AS t FROM {_CHUNKS}) WHERE len(list_filter(t, lambda w: starts_with(w, 'the'))) > 0 AND len(list_filter(t, lambda w: starts_with(w, 'an'))) > 0) SELECT chunk_id, tf FROM m ORDER BY tf DESC, chunk_id LIMIT 30")
def index_prefix_match(spark, sf):
    """Plain words from a stored index: what lexical_prefix_match finds by a scan."""
    asked = spark.createDataFrame([(0, TERMS)], "query_id long, query string")
    return fulltext.stem_search(chunks(spark, sf), asked, "simple", by="tf").select("chunk_id", "tf")


_POOL = "(SELECT doc_id, text, source FROM documents JOIN embeddings ON vec_id = doc_id)"


@query(
    f"WITH asked AS MATERIALIZED (SELECT item_id AS query_id, unnest(t[1:2]) AS token FROM (SELECT item_id, {_TOKENS} AS t FROM benchmark)), {_postings(_POOL, 'doc_id', ', source')},"
    " hits AS MATERIALIZED (SELECT DISTINCT query_id, id, no, pos FROM (SELECT query_id, no, t.term, d.source FROM need JOIN documents d ON d.doc_id = query_id JOIN (SELECT DISTINCT term FROM post) t ON starts_with(t.term, prefix)) m JOIN post USING (term, source)),"
    f" {_BOTH}, l AS (SELECT query_id, id AS chunk_id, tf, row_number() OVER (PARTITION BY query_id ORDER BY tf DESC, id) AS rl FROM full_hits), lt AS (SELECT *, tf * 1.0::DOUBLE / max(tf) OVER (PARTITION BY query_id) AS sl FROM l WHERE rl <= 30),"
    " c AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12) AS sv FROM embeddings q JOIN documents qd ON qd.doc_id = q.vec_id JOIN documents ed ON ed.source = qd.source JOIN embeddings e ON e.vec_id = ed.doc_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)),"
    " v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sv DESC, chunk_id) AS rv FROM c WHERE sv >= 0), vt AS (SELECT * FROM v WHERE rv <= 30),"
    " f AS (SELECT query_id, chunk_id, rv, rl, coalesce(0.7::DOUBLE / (60 + rv), 0) + coalesce(0.3::DOUBLE / (60 + rl), 0) AS fused_score, coalesce(sv, 0) AS vector_score, coalesce(sl, 0) AS lexical_score, CASE WHEN rl IS NULL THEN 'vector' WHEN rv IS NULL THEN 'bm25' ELSE 'both' END AS source FROM vt FULL JOIN lt USING (query_id, chunk_id)),"
    " r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, rv NULLS LAST, rl NULLS LAST, chunk_id) AS INTEGER) AS fused_rank FROM f)"
    " SELECT query_id, chunk_id, round(fused_score, 12) AS fused_score, round(vector_score, 9) AS vector_score, round(lexical_score, 9) AS lexical_score, source, fused_rank FROM r WHERE fused_rank <= 10"
)
def hybrid_batch(spark, sf):
    """Every benchmark passage's first words, with the vector and the collection of the document of its number, ask for
    documents of that collection; one plan for all."""
    pool = vector_chunks(spark, sf).withColumnRenamed("source", "collection")
    words = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(text.terms(F.col("text")), 1, 2), " ").alias("query"))
    asked = words.join(pool.select(F.col("chunk_id").alias("query_id"), "embedding", "collection"), "query_id")
    path = scratch(spark, "index")
    fulltext.write_index(pool, path, "english", ("collection",))
    found = fulltext.hybrid_batch(spark, path, pool, asked, min_similarity=0.0, by="tf")
    return found.select("query_id", "chunk_id", F.round("fused_score", 12).alias("fused_score"), F.round("vector_score", 9).alias("vector_score"), F.round("lexical_score", 9).alias("lexical_score"), "source", "fused_rank")
