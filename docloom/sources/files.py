"""File sources and sinks."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import word_count
from . import commonmark

UPLOAD_LIMIT, REMOTE_LIMIT = 100 << 20, 50 << 20
SAFE_ID, SAFE_EXTENSION = re.compile(r"[A-Za-z0-9-]+"), re.compile(r"\.[A-Za-z0-9]{1,10}")
#: Formats whose parsers are not part of Python: name -> function from bytes to (text, pages).
PARSERS: dict[str, Callable[[bytes], tuple[str, int | None]]] = {}


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, length, content, content_type, title of files; content is only read if asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return found.withColumns({"content_type": urls.content_type(F.col("path"), F.lit(None).cast("string")), "title": urls.title(F.regexp_extract("path", r"([^/]*)$", 1))})


def within_limit(files: DataFrame, most: int = UPLOAD_LIMIT) -> DataFrame:
    return files.filter(F.col("length") <= most)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {id, title, url, topics, summary, content}."""
    return spark.read.schema("id string, title string, url string, topics array<string>, summary string, content string").option("multiLine", "true").json(path)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of a database; partition options spread it over tasks."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


# --- extraction ---


def extractor(content_type: Column) -> Column:
    """Which extractor a content type goes to, in this order; null: none."""
    t = F.lower(content_type)
    has = lambda *xs: F.greatest(*[F.contains(t, F.lit(x)) for x in xs], F.lit(False))
    return F.when(has("pdf"), "pdf").when(has("word", "officedocument", "docx"), "docx").when(has("markdown", "md"), "markdown").when(F.startswith(t, F.lit("text/")) | has("txt"), "text")


def docx_text(content: bytes) -> str:
    """Paragraphs of a word-processing document, a blank line between them."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    part = {f"{w}t": lambda e: e.text or "", f"{w}tab": lambda e: "\t", f"{w}br": lambda e: "\n"}
    return "\n\n".join("".join(part[e.tag](e) for e in p.iter() if e.tag in part) for p in root.iter(f"{w}p")).strip()


def markdown_text(text: str) -> str:
    """The text of Markdown; as it stands if there is none, or if it is nested too deeply to be read."""
    try:
        return commonmark.plain(text) or text
    except RecursionError:
        return text


def extract_one(kind: str | None, content: bytes, parsers: dict[str, Callable]) -> tuple[str, int | None]:
    if kind in parsers:
        return parsers[kind](content)
    if kind == "docx":
        return docx_text(content), None
    if kind in ("markdown", "text"):
        text = content.decode("utf-8", "replace")
        return (markdown_text(text) if kind == "markdown" else text), None
    raise ValueError(f"no extractor for {kind or 'this content type'}")


def extract(files: DataFrame, carry: list[str]) -> DataFrame:
    """carry, text, page_count, word_count, error of files (content, content_type). What can't be extracted has an error
    and no text; plain text is decoded in the JVM, only other kinds reach Python. Markdown's words are those of its
    source."""
    kind = extractor(F.col("content_type"))
    base = files.select(*carry, "content", kind.alias("kind"))
    plain = base.filter("kind = 'text'").select(*carry, F.decode("content", "UTF-8").alias("text"), F.lit(None).cast("int").alias("page_count"), F.decode("content", "UTF-8").alias("raw"), F.lit(None).cast("string").alias("error"))
    rest = base.filter("kind is null or kind <> 'text'")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.select(*carry).schema] + ["text string, page_count int, raw string, error string"])
    parsers = dict(PARSERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content, k in zip(b["content"], b["kind"], strict=True):
                try:
                    text, pages = extract_one(k, bytes(content), parsers)
                    out.append((text, pages, bytes(content).decode("utf-8", "replace") if k == "markdown" else text, None))
                except Exception as e:
                    out.append((None, None, None, str(e)))
            made = pd.DataFrame(out, columns=["text", "page_count", "raw", "error"])
            made["page_count"] = made["page_count"].astype("Int32")
            yield pd.concat([b[carry].reset_index(drop=True), made], axis=1)

    both = plain.unionByName(rest.mapInPandas(run, schema))
    return both.withColumn("word_count", F.when(F.col("error").isNull(), word_count(F.col("raw")))).drop("raw")


# --- sinks ---


def storage_path(root: str, collection: str, doc: str, extension: str) -> str:
    """Where a document's file lies; ids and extension may hold nothing that leads elsewhere."""
    if not (SAFE_ID.fullmatch(collection) and SAFE_ID.fullmatch(doc) and SAFE_EXTENSION.fullmatch(extension)):
        raise ValueError("unsafe collection, document or extension")
    return f"{root}/{collection}/{doc}{extension}"


def store_documents(documents: DataFrame, root: str) -> None:
    """documents (collection, doc, extension, content) as a table below root, a folder for each collection, with the path
    that storage_path() gives; a row whose names could lead elsewhere fails the write."""
    safe = F.col("collection").rlike(f"^(?:{SAFE_ID.pattern})$") & F.col("doc").rlike(f"^(?:{SAFE_ID.pattern})$") & F.col("extension").rlike(f"^(?:{SAFE_EXTENSION.pattern})$")
    path = F.concat("collection", F.lit("/"), "doc", "extension")
    checked = F.when(F.coalesce(safe, F.lit(False)), path).otherwise(F.raise_error(F.lit("unsafe collection, document or extension")))
    documents.select("collection", "doc", checked.alias("path"), "content").write.mode("append").partitionBy("collection").parquet(root)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete_file(spark: SparkSession, path: str) -> bool:
    """False if there was none."""
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """df as a table's next version, df itself being read from it: written beside it, then put in its place by two renames. Between
    them the name has no table: a reader may fail there, and a crash leaves the old version beside it under a name that
    begins with the path. Several tables don't change together."""
    spark, side, old = df.sparkSession, f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(side)
    (fs, p), new = _fs(spark, path), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(side)
    before = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
    if fs.exists(p) and not fs.rename(p, before) or not fs.rename(new, p):
        raise OSError(f"{path} could not be replaced")
    fs.delete(before, True)


def store_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Chunks of whole documents in place of what their buckets hold of those documents. Partitions by a hash of doc_id, so a
    write touches only the buckets of its documents; repeated writes leave the same rows."""
    spark = chunks.sparkSession
    new = chunks.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    fs, p = _fs(spark, path)
    if fs.exists(p):
        touched = new.select("bucket").distinct()
        kept = spark.read.parquet(path).join(F.broadcast(touched), "bucket", "left_semi").join(new.select("doc_id").distinct(), "doc_id", "left_anti")
        merged, side = new.unionByName(kept, allowMissingColumns=True), f"{path}.{uuid.uuid4().hex}"
        merged.write.parquet(side)  # read and written folders must not be one
        new = spark.read.parquet(side)
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        delete_file(spark, side)
    else:
        new.repartition("bucket").write.partitionBy("bucket").parquet(path)
