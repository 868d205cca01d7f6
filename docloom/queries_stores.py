"""Registered queries of sources, sinks, catalogue, ingest and the web, each with its SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schema
from .functions import metadata, rules, text, urls
from .operators import catalog, chunk, cost, embed
from .plans.config import Config
from .plans.ingest import context_of, document_metadata, ingest, status_log
from .plans.tools import Library
from .queries import _CHUNKS, _USAGE, AS_OF, NOW, chunks, documents, query, usage
from .session import load, scratch, stored
from .sources import files, web
from .sources.commits import Store
from .streaming import flows

# --- catalogue ---


@query("SELECT doc_id, TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS created_at FROM documents")
def newest_documents(spark, sf):
    return catalog.newest_first(documents(spark, sf)).select("doc_id", "created_at")


@query("SELECT doc_id FROM documents WHERE source = 'src1'")
def documents_of_collection(spark, sf):
    return catalog.newest_first(documents(spark, sf), "src1").select("doc_id")


@query("SELECT doc_id, source AS collection_id, 'pending' AS status FROM documents WHERE doc_id = 7")
def document_by_id(spark, sf):
    return catalog.by_id(documents(spark, sf), "7").select("doc_id", "collection_id", "status")


@query(f"SELECT chunk_id, chunk_index, text FROM {_CHUNKS} WHERE doc_id = 3")
def chunks_of_document(spark, sf):
    return catalog.chunks_of(chunks(spark, sf), 3).select("chunk_id", "chunk_index", "text")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, n_chars AS file_size, NULL AS file_path, 'pending' AS status, TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS created_at FROM documents UNION ALL SELECT 'new', NULL, NULL, 'pending', {NOW}")
def inserted_document(spark, sf):
    old = load(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("file_size"), F.lit(None).cast("string").alias("file_path"), F.lit("pending").alias("status"), F.create_map().cast("map<string,string>").alias("metadata"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id)").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )
    return catalog.insert_document(old, {"id": "new", "file_size": 0, "file_path": ""}, AS_OF).select("id", "file_size", "file_path", "status", "created_at")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'only' ELSE lang END AS language, CASE WHEN doc_id % 4 <> 0 THEN CASE WHEN doc_id % 7 = 0 THEN 'code_sample' ELSE 'tutorial' END END AS doc_type FROM documents")
def metadata_overwrite(spark, sf):
    found = catalog.overwrite_metadata(documents(spark, sf), F.col("doc_id") % 4 == 0, F.create_map(F.lit("language"), F.lit("only")))
    return found.select("doc_id", *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("language", "doc_type")])


@query(f"SELECT 'document' AS kind, doc_id AS id FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT 'chunk', chunk_id FROM {_CHUNKS} WHERE doc_id % 10 <> 0")
def deleted_documents(spark, sf):
    d = documents(spark, sf).withColumn("id", F.col("doc_id"))
    left, kept = catalog.delete_documents(d, chunks(spark, sf), load(spark, sf, "documents").select(F.col("doc_id").alias("id")).union(chunks(spark, sf).select("doc_id")).distinct().filter("id % 10 = 0"))
    return left.select(F.lit("document").alias("kind"), "id").union(kept.select(F.lit("chunk"), F.col("chunk_id")))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CASE json_type(props, '$.k') WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'number' END AS kind FROM events")
def json_values(spark, sf):
    p = F.col("props")
    return load(spark, sf, "events").select("event_id", metadata.json_text(p, "k").alias("k"), metadata.json_type(p, "k").alias("kind"))


# --- files ---


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def table_source(spark, sf):
    found = files.read_table(spark, f"{sf}/orders.parquet", "o_orderstatus string, o_totalprice double")
    return found.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1")
def replaced_table(spark, sf):
    """A table and its next version, read from itself."""
    path = scratch(spark, "replaced")
    files.append(load(spark, sf, "documents").select("doc_id"), path)
    files.replace(spark.read.parquet(path).filter("doc_id % 2 = 1"), path)
    return spark.read.schema("doc_id long").parquet(path)


@query(f"SELECT chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'again' ELSE text END AS text FROM {_CHUNKS} WHERE doc_id % 3 <> 0 OR chunk_index = 0")
def stored_chunks(spark, sf):
    """Chunks written, then those of some documents written twice in their place, fewer than before."""
    path, c = scratch(spark, "chunks"), chunks(spark, sf).drop("role")
    files.store_chunks(c, path, 8)
    for _ in "12":
        files.store_chunks(c.filter("doc_id % 3 = 0 and chunk_index = 0").withColumn("text", F.lit("again")), path, 8)
    return spark.read.parquet(path).select("chunk_id", "text")


@query("SELECT event_id AS usage_id, event_id % 2 = 0 AS twice, CAST(round(CAST(CASE event_id % 4 WHEN 1 THEN CAST(round(value * 100) AS BIGINT) / 1000 * 0.00012 WHEN 2 THEN CAST(round(value * 100) AS BIGINT) / 1000 * 0.001 ELSE CAST(round(value * 100) AS BIGINT) / 1000 * 0.00025 END AS DECIMAL(30,12)), 4) AS DOUBLE) AS cost_usd FROM events WHERE event_id % 4 <> 0 UNION ALL SELECT -1, NULL, CAST((SELECT count(*) FROM events WHERE event_id % 4 <> 0) AS DOUBLE)")
def appended_usage(spark, sf):
    """Usage priced and appended in two writes; the local embedder is not tracked. The last row counts what is stored."""
    path = scratch(spark, "usage")
    given = usage(spark, sf).withColumns({"provider": F.when(F.col("provider") == "openai", "ollama").otherwise(F.col("provider")), "model": F.lit(None).cast("string"), "operation": F.lit("embed")})
    for part in (0, 1):
        files.append(cost.tracked(given.filter(F.col("usage_id") % 2 == part)).select("usage_id", (F.col("usage_id") % 2 == 0).alias("twice"), F.col("cost_usd").cast("double").alias("cost_usd")), path)
    found = spark.read.parquet(path)
    return found.union(found.agg(F.lit(-1).cast("long"), F.lit(None).cast("boolean"), F.count("*").cast("double")))


@query("SELECT CAST(item_id AS VARCHAR) AS id, 'Item ' || item_id AS title, len(topics) AS n_topics, text AS content FROM (SELECT *, [CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END, 'all'] AS topics FROM benchmark)")
def json_corpus(spark, sf):
    """Items written as files that hold a JSON array each, and read again."""
    path = scratch(spark, "corpus")
    item = F.struct(F.col("item_id").cast("string").alias("id"), F.concat(F.lit("Item "), "item_id").alias("title"), F.array(F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd"), F.lit("all")).alias("topics"), F.col("text").alias("content"))
    arrays = load(spark, sf, "benchmark").groupBy((F.col("item_id") / 10).cast("int").alias("b")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(item)), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_corpus(spark, path).select("id", "title", F.size("topics").cast("long").alias("n_topics"), "content")


_KIND = "CASE doc_id % 5 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'image/png' END"


@query(
    "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN lang || chr(10) || chr(10) || source || ' x' WHEN 2 THEN 'pages of ' || lang WHEN 3 THEN lang || chr(10) || chr(10) || source END AS text, CASE WHEN doc_id % 5 = 2 THEN 3 END AS page_count,"
    " CASE doc_id % 5 WHEN 0 THEN CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 0 ELSE len(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) END WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 2 END AS word_count, doc_id % 5 = 4 AS failed FROM documents"
)
def extracted_files(spark, sf):
    """Files of every kind: plain text, Markdown, a kind with a registered parser, word-processing files, and one without."""
    files.PARSERS["pdf"] = _pages_of
    kind = F.expr(_KIND)
    markdown = F.concat(F.lit("# "), "lang", F.lit("\n\n**"), "source", F.lit("** [x](u)"))
    given = load(spark, sf, "documents").select("doc_id", kind.alias("content_type"), F.when(F.col("doc_id") % 5 == 1, markdown).when(F.col("doc_id") % 5 == 3, F.concat("lang", F.lit("\n"), "source")).when(F.col("doc_id") % 5 == 2, F.col("lang")).otherwise(F.col("text")).alias("t"))
    made = given.mapInPandas(_as_files, "doc_id long, content_type string, content binary")
    return files.extract(made, ["doc_id"]).select("doc_id", "text", "page_count", "word_count", F.col("error").isNotNull().alias("failed"))


def _pages_of(content: bytes) -> tuple[str, int]:
    """What stands for a parser of paged files."""
    return f"pages of {content.decode()}", 3


def _as_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import io
    import zipfile

    def made(kind: str, t: str | None) -> bytes:
        if "officedocument" not in kind:
            return (t or "").encode()
        body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in (t or "").split("\n"))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        return out.getvalue()

    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "content_type": b["content_type"], "content": [made(k, t) for k, t in zip(b["content_type"], b["t"], strict=True)]})


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ' ' || source || '.pdf' WHEN 1 THEN 'x y' || doc_id || '.md' END AS name FROM documents")
def content_disposition_names(spark, sf):
    header = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('attachment; filename="'), "lang", F.lit(" "), "source", F.lit('.pdf"'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("attachment; filename*=UTF-8''x%20y"), "doc_id", F.lit(".md"))).otherwise("inline")
    return load(spark, sf, "documents").select("doc_id", urls.disposition_name(header).alias("name"))


@query("SELECT doc_id FROM documents WHERE n_chars <= 2000")
def uploads_within_limit(spark, sf):
    return files.within_limit(load(spark, sf, "documents").withColumn("length", F.col("n_chars")), 2000).select("doc_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc, source || '/' || doc_id || '.txt' AS path, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents")
def stored_documents(spark, sf):
    root = scratch(spark, "files")
    given = load(spark, sf, "documents").select(F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("doc"), F.lit(".txt").alias("extension"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    files.store_documents(given, root)
    return spark.read.parquet(root).select("doc", "path", F.length("content").cast("long").alias("n_bytes"))


@query("SELECT page_id, CASE WHEN s = '' THEN regexp_extract(url, '^https?://([^/?#]+)', 1) ELSE trim(translate(s, '-_', '  ')) END AS title FROM (SELECT page_id, url, regexp_extract(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '([^/]+)/*$', 1) AS s FROM pages)")
def url_titles(spark, sf):
    return load(spark, sf, "pages").select("page_id", urls.title(F.col("url")).alias("title"))


# --- web ---

_NORMAL = lambda u: (  # noqa: E731  for the pages' URLs: lower-case hosts, no ports
    f"regexp_extract({u}, '^(https?://[^/?#]+)', 1) || CASE WHEN regexp_replace(regexp_replace(regexp_extract({u}, '^https?://[^/?#]+([^?#]*)', 1), '/+', '/', 'g'), '/$', '') = '' THEN '/' ELSE regexp_replace(regexp_replace(regexp_extract({u}, '^https?://[^/?#]+([^?#]*)', 1), '/+', '/', 'g'), '/$', '') END"
    f" || CASE WHEN regexp_extract({u}, '\\?([^#]*)', 1) = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&')), '&') END"
)


@query(f"SELECT DISTINCT {_NORMAL('url')} AS src, {_NORMAL('href')} AS dst FROM (SELECT url, regexp_extract(url, '^(https?://[^/?#]+)', 1) || unnest(regexp_extract_all(html, '<a href=\"(/[^/\"][^\"]*)\"', 1)) AS href FROM pages)")
def page_links(spark, sf):
    return web.links(load(spark, sf, "pages"))


@query(
    f"WITH RECURSIVE p AS (SELECT page_id, {_NORMAL('url')} AS url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages), ring AS (SELECT DISTINCT url AS src, lead(url) OVER (PARTITION BY host ORDER BY page_id) AS dst FROM p),"
    " walk AS (SELECT (SELECT url FROM p ORDER BY page_id LIMIT 1) AS url, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN ring ON src = url WHERE dst IS NOT NULL AND depth < 60)"
    " SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY url ORDER BY min(depth), url LIMIT 25"
)
def crawl(spark, sf):
    """Breadth-first over pages of a host linked in order of their numbers."""
    from pyspark.sql import Window

    p = load(spark, sf, "pages").withColumn("host", urls.part(F.col("url"), 2))
    ring = p.select(urls.normalised(F.col("url")).alias("src"), urls.normalised(F.lead("url").over(Window.partitionBy("host").orderBy("page_id"))).alias("dst")).filter("dst is not null").distinct()
    start = p.orderBy("page_id").first()["url"]
    return spark.createDataFrame(web.crawl(p, ring, start), "url string, depth int")


# --- ingest ---

_ENDS = r"[ \t\n\r\x0B\f\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_GAP = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STOP = r"""[.!?]["'')\]]*""" + _GAP + "+"
_TWO = "chr(10) || chr(10)"
#: Chunks of documents: a step for each chunk, each from the place where the last one let it begin.
_CUT = f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '^{_ENDS}+|{_ENDS}+$', '', 'g') AS s FROM documents),
 c AS (SELECT doc_id, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS last, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS body, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS e, s = '' AS done FROM t UNION ALL
  SELECT doc_id, CASE WHEN text = '' THEN lim WHEN n > 0 AND stop <= last THEN stop WHEN fin - 150 > start THEN fin - 150 ELSE fin END, CASE WHEN emit THEN stop ELSE last END, CASE WHEN emit THEN n + 1 ELSE n END, CASE WHEN emit THEN text END, CASE WHEN emit THEN start END,
   CASE WHEN emit THEN stop END, emit AND fin >= size FROM (SELECT *, text <> '' AND (n = 0 OR stop > last) AS emit FROM (SELECT *, start + length(text) AS stop FROM (SELECT *, regexp_replace(substr(s, start + 1, fin - start), '{_ENDS}+$', '') AS text FROM (SELECT *,
   CASE WHEN start + 800 >= size THEN size WHEN para > 0 THEN start + para WHEN sent > 0 THEN start + sent WHEN late > 0 THEN start + 800 + late ELSE start + 800 END AS fin,
   CASE WHEN start + 800 >= size THEN size WHEN para > 0 OR sent > 0 OR late = 0 THEN start + 800 ELSE least(size, start + 950) END AS lim FROM (SELECT *,
   CASE WHEN q > 0 AND length(rtrim(substr(w, 1, q), chr(10))) > 0 THEN q + 2 + length(regexp_extract(substr(s, start + q + 3), '^\\n*')) ELSE 0 END AS para, length(regexp_extract(substr(s, start + 1, 800), '^([\\s\\S]*{_STOP})', 1)) AS sent,
   length(regexp_extract(substr(s, start + 801, 150), '^([\\s\\S]*?{_STOP})', 1)) AS late FROM (SELECT *, CASE WHEN contains(w, {_TWO}) THEN length(w) - strpos(reverse(w), {_TWO}) - 1 ELSE 0 END AS q FROM (
   SELECT c.*, t.s, length(t.s) AS size, substr(t.s, start + 1, 801) AS w FROM c JOIN t USING (doc_id) WHERE NOT done AND start < length(t.s)))))))))"""
_PIECES = "(SELECT doc_id, CAST(n - 1 AS INTEGER) AS chunk_index, body AS text, CAST(b AS INTEGER) AS start_offset, CAST(e AS INTEGER) AS end_offset, CAST(ceil(length(body) / 4.0) AS INTEGER) AS token_count, regexp_replace(split_part(body, chr(10), 1), '^" + _ENDS + "+|" + _ENDS + "+$', '', 'g') AS h FROM c WHERE body IS NOT NULL)"


@query(f"{_CUT} SELECT doc_id, chunk_index, text, start_offset, end_offset, CASE WHEN length(h) <= 120 AND regexp_matches(h, '^[#A-Z]') THEN h END AS heading, token_count FROM {_PIECES}")
def chunk_documents(spark, sf):
    return chunk.chunk_documents(load(spark, sf, "documents"), ["doc_id"])


_CODE = r"contains(text, '//') OR regexp_matches(text, '(?m)^\s*(import|export)\s+|^\s*(class|interface|enum)\s+\w+|^\s*(async\s+)?function\s+\w+|\bconst\s+\w+\s*=|#include\s+<') OR regexp_matches(text, '<\w+>\s*\(.*\)')"


@query(
    f"{_CUT} SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 7 = 0 OR {_CODE} THEN 'voyage' ELSE 'ollama' END AS embedding_provider, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS tokens"
    f" FROM {_PIECES} WHERE doc_id % 5 <> 0 GROUP BY ALL"
)
def ingested_documents(spark, sf):
    d = documents(spark, sf).select("id", "text", F.col("error_message").alias("error"), "metadata", "file_path", F.lit("text/plain").alias("content_type"))
    made, _ = ingest(d)
    return made.groupBy("doc_id", "embedding_provider").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("tokens"))


_PATH = "CASE doc_id % 6 WHEN 0 THEN '/a/x.dart' WHEN 1 THEN '/a/x.TSX' WHEN 2 THEN '/a/x.yml' WHEN 3 THEN '/a/x.md' END"


@query(
    "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'code' WHEN doc_id % 5 = 0 THEN 'personal' WHEN doc_id % 3 = 0 THEN 'docs' WHEN doc_id % 6 IN (0, 1) THEN 'code' ELSE 'docs' END AS context,"
    " CASE WHEN doc_id % 3 = 0 THEN lang ELSE CASE doc_id % 6 WHEN 0 THEN 'dart' WHEN 1 THEN 'typescript' WHEN 2 THEN 'yaml' WHEN 3 THEN 'markdown' END END AS language FROM documents"
)
def content_contexts(spark, sf):
    kind = F.when(F.col("doc_id") % 7 == 0, "code_sample").when(F.col("doc_id") % 5 == 0, "personal_writing")
    meta = F.map_filter(F.map_from_arrays(F.array(F.lit("doc_type"), F.lit("language")), F.array(kind, F.when(F.col("doc_id") % 3 == 0, F.col("lang")))), lambda _, v: v.isNotNull())
    context, language = context_of(meta, F.expr(_PATH), F.lit("text/plain"))
    return load(spark, sf, "documents").select("doc_id", context.alias("context"), language.alias("language"))


@query(
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'official' WHEN doc_id % 4 = 1 THEN 'verified' WHEN doc_id % 4 = 2 THEN 'community' ELSE 'verified' END AS source_quality, CASE WHEN doc_id % 4 = 1 THEN 'repo' ELSE 'tutorial' END AS doc_type,"
    " CASE WHEN doc_id % 2 = 0 THEN 'base,' || lang || ',own' ELSE 'base' END AS tags FROM documents"
)
def built_metadata(spark, sf):
    i = F.col("doc_id")
    url = F.when(i % 4 == 0, "https://docs.flutter.dev/x").when(i % 4 == 1, "https://github.com/a/b").when(i % 4 == 2, "https://x.org/y")
    given = load(spark, sf, "documents").select("doc_id", url.alias("source_url"), F.lit(None).cast("string").alias("file_path"), F.when(i % 2 == 0, F.create_map(F.lit("tags"), F.concat("lang", F.lit(",own")))).alias("metadata"))
    key = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return document_metadata(given, "verified", ("base",)).select("doc_id", key("source_quality"), key("doc_type"), key("tags"))


@query(
    "SELECT chunk_id, CASE WHEN doc_id % 2 = 0 THEN 'voyage' ELSE 'ollama' END AS embedding_provider, CASE WHEN doc_id % 2 = 0 THEN 'voyage-code-2' ELSE 'nomic-embed-text' END AS embedding_model,"
    f" CASE WHEN doc_id % 2 = 0 THEN 1024 ELSE 768 END AS embedding_dimensions, false AS used_fallback, 1.0::DOUBLE AS norm FROM {_CHUNKS}"
)
def embedded_chunks(spark, sf):
    from .functions import vectors

    given = chunks(spark, sf).withColumn("provider", F.when(F.col("doc_id") % 2 == 0, "voyage"))
    made = embed.embed(given, ["chunk_id"])
    return made.select("chunk_id", "embedding_provider", "embedding_model", "embedding_dimensions", "used_fallback", F.round(vectors.norm(F.col("embedding")), 4).alias("norm"))


@query(
    "SELECT doc_id, unnest(s) AS status FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ['extracting', 'error'] WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN ['extracting', 'chunking', 'complete']"
    " ELSE ['extracting', 'chunking', 'embedding', 'complete'] END AS s FROM documents)"
)
def ingest_states(spark, sf):
    """The states that each document goes through: those in error, without text, and all others."""
    d = documents(spark, sf).select("id", "doc_id", "text", F.col("error_message").alias("error"), "metadata", "file_path", F.lit("text/plain").alias("content_type"))
    made, outcomes = ingest(d)
    return status_log(outcomes, made.select("doc_id"), AS_OF).select(F.col("id").cast("long").alias("doc_id"), "status")


@query(f"SELECT usage_id, round(CASE usage_id % 3 WHEN 0 THEN CASE WHEN usage_id % 2 = 0 THEN tokens_used / 1000 * 0.03 ELSE tokens_used / 1000 * 0.00013 END WHEN 1 THEN 0.001 ELSE 0 END, 9) AS price FROM {_USAGE}")
def model_prices(spark, sf):
    """Known and unknown models, reranking by the request, an unknown provider."""
    i = F.col("usage_id")
    provider, model = F.when(i % 3 == 0, "openai").when(i % 3 == 1, "cohere").otherwise("who"), F.when(i % 2 == 0, "gpt-4").otherwise("unheard of")
    return usage(spark, sf).select("usage_id", F.round(rules.price(provider, model, F.lit("rerank"), F.col("tokens_used")), 9).alias("price"))


_OVER = f"over_ AS (SELECT CASE WHEN s >= 100 THEN 'limit_reached' WHEN s > 80 THEN 'warning' END AS alert_type, created_at, usage_id, CAST(s AS DOUBLE) AS s FROM (SELECT *, sum(cost_usd) OVER (PARTITION BY date_trunc('month', created_at) ORDER BY created_at, usage_id ROWS UNBOUNDED PRECEDING) AS s FROM {_USAGE}))"


@query(
    f"WITH RECURSIVE {_OVER}, c AS (SELECT * FROM over_ WHERE alert_type IS NOT NULL), chain AS (SELECT alert_type, min({{'t': created_at, 'u': usage_id, 's': s}}) AS x FROM c GROUP BY alert_type"
    " UNION ALL SELECT c.alert_type, min({'t': c.created_at, 'u': c.usage_id, 's': c.s}) FROM chain JOIN c ON c.alert_type = chain.alert_type AND c.created_at >= chain.x.t + INTERVAL 24 HOUR GROUP BY c.alert_type)"
    " SELECT alert_type, x.t AS triggered_at, x.u AS usage_id, x.s AS current_spend_usd FROM chain"
)
def alert_replay(spark, sf):
    return cost.replay_alerts(usage(spark, sf), 100)


@query(
    f"WITH RECURSIVE {_OVER}, c AS (SELECT alert_type, created_at AS t FROM over_ WHERE alert_type IS NOT NULL), chain AS (SELECT alert_type, min(t) AS t FROM c GROUP BY alert_type UNION ALL SELECT c.alert_type, min(c.t) FROM chain JOIN c ON c.alert_type = chain.alert_type AND c.t >= chain.t + INTERVAL 24 HOUR GROUP BY c.alert_type)"
    " SELECT alert_type, t AS triggered_at FROM chain"
)
def alert_stream(spark, sf):
    """The requests beyond the budget come as files in time slices, a fifth of them one slice late; suppressed by event time
    over several triggers they raise what the replay of the whole log raises."""
    over = stored(cost.over_budget(usage(spark, sf), 100).select("alert_type", F.col("created_at").cast("timestamp").alias("triggered_at")), "over-budget")
    seconds = F.unix_timestamp("triggered_at")
    first, last = over.agg(F.min(seconds), F.max(seconds)).first()
    if first is None:
        return over.select("alert_type", F.col("triggered_at").cast("timestamp_ntz").alias("triggered_at"))
    slices, base = 4, scratch(spark, "alert-stream")
    width = (last - first) // slices + 1
    at = F.floor((seconds - first) / width).cast("int") + F.when(F.pmod(F.xxhash64("triggered_at"), F.lit(5)) == 0, 1).otherwise(0)
    for i in range(slices + 1):
        over.filter(at == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    spark.range(1).select(F.lit("end").alias("alert_type"), F.timestamp_seconds(F.lit(last + 4 * width)).alias("triggered_at")).write.mode("append").parquet(f"{base}/in")
    out, few = over.schema, {"spark.sql.streaming.stateStore.providerClass": flows.ROCKSDB, "spark.sql.shuffle.partitions": "4"}  # two types of alerts
    before = {k: spark.conf.get(k) for k in few}
    try:
        for k, v in few.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(out).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        found = flows.suppressed(stream, late=f"{2 * width} seconds")
        found.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(out).parquet(f"{base}/out").filter("alert_type <> 'end'").select("alert_type", F.col("triggered_at").cast("timestamp_ntz").alias("triggered_at"))


@query(f"SELECT usage_id FROM {_USAGE} WHERE usage_id % 50 = 0 AND usage_id % 100 <> 0")
def new_alerts(spark, sf):
    """Candidates of which every second one follows a stored alert of its type within a day."""
    u = usage(spark, sf).filter("usage_id % 50 = 0").select("usage_id", F.col("usage_id").cast("string").alias("alert_type"), F.lit("monthly").alias("period"), F.col("created_at").alias("triggered_at"))
    stored = u.filter("usage_id % 100 = 0").withColumn("triggered_at", F.col("triggered_at") - F.expr("INTERVAL 23 HOURS")).union(u.filter("usage_id % 100 <> 0").withColumn("triggered_at", F.col("triggered_at") - F.expr("INTERVAL 24 HOURS")))
    return cost.new_alerts(u, stored).select("usage_id")


@query(f"SELECT chunk_id, substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 420) AS text FROM {_CHUNKS}")
def snippets(spark, sf):
    return chunks(spark, sf).select("chunk_id", text.shortened(text.squeezed(F.col("text")), 420).alias("text"))


_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[\\t\\f\\r ]+', ' ', 'g'), ' ')), lambda x: x <> '')"


@query(f"SELECT doc_id, lang || CASE WHEN len(l) > 0 THEN chr(10) || chr(10) ELSE '' END || array_to_string(l, chr(10) || chr(10)) AS text FROM (SELECT doc_id, lang, {_LINES} AS l FROM documents)")
def markdown_documents(spark, sf):
    """Whole documents written as Markdown (a heading, then lines by turns as emphasised paragraphs, items, quotes and code,
    every mark in them escaped) and read back."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, "[\\t\\f\\r ]+", " "))), lambda x: x != "")
    safe = lambda x: F.regexp_replace(x, r"([!-/:-@\[-`{-~])", r"\\$1")
    kinds = lambda x, i: (
        F.when(i % 5 == 0, F.concat(F.lit("**"), safe(x), F.lit("**"))).when(i % 5 == 1, F.concat(F.lit("- "), safe(x))).when(i % 5 == 2, F.concat(F.lit("> 1. "), safe(x)))
        .when(i % 5 == 3, F.concat(F.lit("~~~~~~~~~~\n"), x, F.lit("\n~~~~~~~~~~"))).otherwise(F.concat(F.lit("["), safe(x), F.lit("](/u 't')")))
    )
    source = F.concat(F.lit("# "), "lang", F.lit(" #\n\n"), F.array_join(F.transform(lines, kinds), "\n\n"))
    given = load(spark, sf, "documents").select("doc_id", source.cast("binary").alias("content"), F.lit("text/markdown").alias("content_type"))
    return files.extract(given, ["doc_id"]).select("doc_id", "text")


# --- typed metadata ---


@query(
    "SELECT doc_id, CASE WHEN source <> 'src1' THEN CAST(json_object('deep', json_object('z', doc_id), 'lang', lang, 'list', json_array(doc_id, 1.5::DOUBLE, source, NULL), 'n_chars', n_chars, 'page', json_array(n_chars, true)) AS VARCHAR)"
    " ELSE CAST(json_object('deep', json_object('a', json_object('b', n_chars), 'source', source), 'lang', lang, 'list', json_array(doc_id, 1.5::DOUBLE, source, NULL), 'n_chars', n_chars) AS VARCHAR) END AS metadata,"
    " CASE WHEN source <> 'src1' THEN n_chars END AS page, CASE WHEN source = 'src1' THEN n_chars END AS deep_b, n_chars * 2 AS twice, CASE WHEN source <> 'src1' THEN 'array' END AS page_kind FROM documents"
)
def metadata_typed_merge(spark, sf):
    """Numbers, lists and nested objects keep their types; a nested object is replaced whole."""
    d = load(spark, sf, "documents")
    left = F.to_json(F.struct(F.struct(F.struct(F.col("n_chars").alias("b")).alias("a"), "source").alias("deep"), "lang", "n_chars"), {"ignoreNullFields": "false"})
    items = F.concat(F.lit('{"list":['), F.col("doc_id"), F.lit(',1.5,"'), F.col("source"), F.lit('",null]}'))
    more = F.concat(F.lit('{"deep":{"z":'), F.col("doc_id"), F.lit('},"page":['), F.col("n_chars"), F.lit(",true]}"))
    given = d.withColumn("metadata", metadata.merged(F.parse_json(left), F.parse_json(items)))
    found = catalog.merge_metadata(given, F.col("source") != "src1", F.parse_json(more))
    get = lambda path, kind: metadata.value(F.col("metadata"), path, kind)
    text_ = F.to_json("metadata")
    return found.select("doc_id", text_.alias("metadata"), get("$.page[0]", "bigint").alias("page"), get("$.deep.a.b", "bigint").alias("deep_b"), (get("$.n_chars", "bigint") * 2).alias("twice"), metadata.json_type(text_, "page").alias("page_kind"))


# --- commits of several tables ---


def _as(df: DataFrame, kind: T.StructType) -> DataFrame:
    """df's columns as a table of the model, the missing ones null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])


def _library(spark: SparkSession, sf: str) -> Library:
    """Collections, documents and chunks of the test tables in one commit."""
    lib = Library(spark, scratch(spark, "library"), Config(as_of=AS_OF))
    docs, at = documents(spark, sf), F.lit(AS_OF)
    c = docs.select(F.col("collection_id").alias("id"), F.col("collection_id").alias("name")).distinct().withColumns({"created_at": at, "updated_at": at})
    lib.load(
        collections=_as(c, schema.COLLECTIONS), documents=_as(docs.withColumn("updated_at", at), schema.DOCUMENTS),
        chunks=_as(chunks(spark, sf).withColumnRenamed("chunk_id", "id"), schema.CHUNKS),
    )
    return lib


@query(
    "SELECT 'collection' AS kind, source AS id FROM documents WHERE source <> 'src1' GROUP BY source UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR) FROM documents WHERE source <> 'src1'"
    f" UNION ALL SELECT 'chunk', CAST(chunk_id AS VARCHAR) FROM {_CHUNKS} WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1')"
)
def facade_delete(spark, sf):
    """A collection goes with its documents and their chunks in one commit."""
    lib = _library(spark, sf)
    lib.delete_collection("src1")
    at = lib.store.snapshot()
    left = [lib.table(f"{kind}s", at).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id")) for kind in ("collection", "document", "chunk")]
    return left[0].union(left[1]).union(left[2])


@query("SELECT source AS id, count(*) AS doc_count FROM documents GROUP BY source")
def facade_collections(spark, sf):
    return _library(spark, sf).list_collections().select("id", "doc_count")


@query(
    f"SELECT d.doc_id AS id, d.status, count(c.chunk_id) AS chunk_count, CAST(sum(c.token_count) AS BIGINT) AS token_count FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'error' WHEN doc_id % 2 = 0 THEN 'complete' ELSE 'pending' END AS status FROM documents"
    f" WHERE source = 'src2' ORDER BY doc_id DESC LIMIT 50) d LEFT JOIN {_CHUNKS} c ON c.doc_id = d.doc_id GROUP BY ALL"
)
def facade_documents(spark, sf):
    return _library(spark, sf).list_documents("src2").select(F.col("id").cast("long").alias("id"), "status", "chunk_count", "token_count")


@query(f"SELECT chunk_id, doc_id, chunk_index, CASE WHEN short THEN 'again' ELSE text END AS text FROM (SELECT *, length(first_value(text) OVER (PARTITION BY doc_id ORDER BY chunk_index)) < 200 AS short FROM {_CHUNKS}) WHERE NOT short OR chunk_index = 0")
def chunk_increments(spark, sf):
    """Conversations whose first turn is short come again as one chunk, twice by the same batch, and the store is compacted."""
    rows = chunks(spark, sf).select("chunk_id", "doc_id", "chunk_index", "text")
    store = Store(spark, scratch(spark, "store"), {"chunks": rows.schema}, {"chunks": "doc_id"})
    store.append(chunks=rows)
    new = rows.filter("chunk_index = 0 and length(text) < 200").withColumn("text", F.lit("again"))
    for _ in range(2):
        store.transact(lambda _: {"chunks": store.put("chunks", new)}, ("again", 1))
    store.compact("chunks")
    return store.read("chunks")


_ADDRESS = "SELECT page_id, o, r, o * 16777216 + r AS v, page_id % 5 AS form FROM (SELECT page_id, [10, 127, 172, 192, 169, 8][page_id % 6 + 1]::BIGINT AS o, CASE WHEN page_id % 4 = 3 THEN 11010048 + page_id ELSE (page_id * 2654435761) % 16777216 END AS r FROM pages)"


@query(
    f"SELECT page_id, 'http://' || o || '.' || (r // 65536) || '.' || ((r // 256) % 256) || '.' || (r % 256) || '/' AS url,"
    f" NOT (o IN (10, 127) OR (o = 172 AND r // 65536 BETWEEN 16 AND 31) OR (o = 192 AND r // 65536 = 168) OR (o = 169 AND r // 65536 = 254)) AS is_public FROM ({_ADDRESS})"
)
def public_addresses(spark, sf):
    """Addresses written as one number in three bases, in two parts, or with a last dot come out as four numbers, and are
    judged as those."""
    i = F.col("page_id")
    o = F.element_at(F.array(*[F.lit(x).cast("long") for x in (10, 127, 172, 192, 169, 8)]), (i % 6 + 1).cast("int"))
    r = F.when(i % 4 == 3, 11010048 + i).otherwise((i * 2654435761) % 16777216)
    v = o * 16777216 + r
    dotted = F.concat_ws(".", o.cast("string"), F.concat(F.lit("0x"), F.hex(F.shiftright(r, 16))), F.concat(F.lit("0"), F.conv(F.shiftright(r, 8).bitwiseAND(F.lit(255)), 10, 8)), r.bitwiseAND(F.lit(255)).cast("string"))
    forms = [v.cast("string"), F.concat(F.lit("0X"), F.hex(v)), F.concat(F.lit("0"), F.conv(v, 10, 8)), F.concat(o.cast("string"), F.lit("."), r.cast("string")), F.concat(dotted, F.lit("."))]
    url = F.concat(F.lit("http://"), F.element_at(F.array(*forms), (i % 5 + 1).cast("int")))
    return load(spark, sf, "pages").select("page_id", urls.standard(url).alias("url"), urls.is_public(url).alias("is_public"))
