"""URL normalisation, the public-address test, and inference of types, extensions and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import hosts

# File extensions and their types.
MIME = {
    ".pdf": "application/pdf", ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".md": "text/markdown",
    ".markdown": "text/markdown", ".txt": "text/plain", ".html": "text/html", ".htm": "text/html", ".json": "application/json", ".csv": "text/csv",
}
EXTENSION = {mime: min((e for e, m in MIME.items() if m == mime), key=len) for mime in MIME.values()} | {"text/html": ".html"}
_PARTS = r"^(?i)(https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\[\]]+)(:\d*)?(/[^?#]*)?(\?[^#]*)?(#.*)?$"


def part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def normalised(url: Column) -> Column:
    """Scheme and host in lower case, default port and fragment dropped, query parameters sorted by name (stably), runs of
    / made one and a trailing / dropped, but the path / kept. Other schemes and what is no URL stay as they are."""
    scheme, port, path, query = F.lower(part(url, 1)), part(url, 3), part(url, 4), F.substring(part(url, 5), F.lit(2), F.length(url))
    port = F.when((port == ":") | ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443")), "").otherwise(port)
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")
    path = F.when(path == "", "/").otherwise(path)
    numbered = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p, i: F.struct(F.split(p, "=")[0].alias("k"), i.alias("i"), p.alias("p")))
    sorted_ = F.array_join(F.transform(F.array_sort(numbered), lambda x: x["p"]), "&")
    whole = F.concat(scheme, F.lit("://"), F.lower(part(url, 2)), port, path, F.when(sorted_ == "", "").otherwise(F.concat(F.lit("?"), sorted_)))
    return F.when(url.rlike(_PARTS), whole).otherwise(url)


def _cleaned(url: Column) -> Column:
    """Without control characters and spaces at the ends, tabs and line ends within, and with / for the \\ of the authority
    and path."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    head = F.regexp_extract(bare, r"^(?i)(https?:[^?#]*)", 1)
    slashed = F.regexp_replace(F.translate(head, "\\", "/"), r"^(?i)(https?):/*", "$1://")
    return F.when(head != "", F.concat(slashed, F.substring(bare, F.length(head) + 1, F.length(bare)))).otherwise(bare)


def _segments(path: Column) -> Column:
    """A path without empty segments and its . and .. resolved."""
    dot = lambda s, n: F.regexp_replace(F.lower(s), "%2e", ".") == "." * n
    none = F.array().cast("array<string>")
    kept = F.filter(F.split(path, "/"), lambda s: (s != "") & ~dot(s, 1))
    return F.aggregate(kept, none, lambda acc, s: F.when(dot(s, 2), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))


def _encoded_path(path: Column) -> Column:
    """Characters that a path can't hold, percent-encoded; what is encoded already stays."""
    plain = path.rlike(r"^[!$-;=@-Z\[\\\]_a-z|~^]*$")
    each = F.transform(F.split(path, ""), lambda c: F.when(c.rlike(r"[^\x21-\x7e]|[\"#<>?`{}]"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    return F.when(plain, path).otherwise(F.array_join(each, ""))


def _sorted_query(query: Column) -> Column:
    """Parameters decoded, sorted by name (stably) and encoded as forms are."""
    decoded = lambda x: F.try_url_decode(F.regexp_replace(x, "%(?![0-9a-fA-F]{2})", "%25"))
    named = lambda p, i: F.struct(decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), i.alias("i"), decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"))
    pairs = F.array_sort(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), named))
    return F.array_join(F.transform(pairs, lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))), "&")


def standard(url: Column) -> Column:
    """An http(s) URL as the public standard spells it: scheme and host canonical, default port and fragment dropped, .
    and .. resolved, path percent-encoded, query parameters sorted by name (stably) and form-encoded, runs of / made one
    and a trailing / dropped, but the path / kept. Other schemes and what is no URL stay as they are. normalised() is the
    plain form, which leaves characters and hosts as they are written."""
    return hosts.let(_cleaned(url), lambda clean: F.when(clean.rlike(_PARTS), F.coalesce(_whole(clean), url)).otherwise(url))


def _whole(clean: Column) -> Column:
    scheme, user = F.lower(part(clean, 1)), F.regexp_extract(clean, r"^(?i)https?://([^/?#@]+@)", 1)
    number = F.substring(part(clean, 3), 2, 12).try_cast("int")
    port = F.when(number.isNull() & (F.length(part(clean, 3)) < 2) | (number == F.when(scheme == "http", 80).otherwise(443)), "").when(number < 65536, F.concat(F.lit(":"), number.cast("string")))
    path = F.concat(F.lit("/"), hosts.let(F.array_join(_segments(part(clean, 4)), "/"), _encoded_path))
    query = hosts.let(_sorted_query(F.substring(part(clean, 5), F.lit(2), F.length(clean))), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.concat(scheme, F.lit("://"), user, hosts.canonical(part(clean, 2)), port, path, query)


def is_public(url: Column) -> Column:
    """An http(s) URL whose host, made canonical, is a name but localhost, or an address outside the loopback, private and
    link-local ranges."""
    public = lambda clean: F.when(clean.rlike(_PARTS), hosts.is_public(hosts.canonical(part(clean, 2))))
    return F.coalesce(hosts.let(_cleaned(url), public), F.lit(False))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def extension(source: Column) -> Column:
    """The last name's extension with its dot, as written; empty if none."""
    return F.regexp_extract(F.regexp_extract(source, r"([^/]*)/*$", 1), r"[^.](\.[^.]*)$", 1)


def content_type(source: Column, explicit: Column) -> Column:
    given = F.trim(F.split(explicit, ";")[0])
    return F.coalesce(F.nullif(given, F.lit("")), F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), F.lower(extension(source))), F.lit("application/octet-stream"))


def file_extension(type_: Column, source: Column) -> Column:
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSION.items() for x in kv]), F.trim(F.split(F.coalesce(type_, F.lit("")), ";")[0]))
    return F.coalesce(known, F.nullif(extension(source), F.lit("")), F.lit(".bin"))


def title(source: Column) -> Column:
    """From the last part of a URL's path (else its host) or a file's name less its extension; - and _ become spaces."""
    slug = F.regexp_extract(part(source, 4), r"([^/]+)/*$", 1)
    slug = F.when(slug == "", part(source, 2)).otherwise(slug)
    of_url = F.trim(F.coalesce(F.try_url_decode(F.regexp_replace(F.translate(slug, "-_", "  "), r"\+", "%2B")), slug))
    base = F.regexp_extract(source, r"([^/]*)/*$", 1)
    of_file = F.trim(F.translate(F.regexp_replace(base, r"\.[^.]+$", ""), "-_", "  "))
    return F.when(source.rlike(_PARTS), F.when(of_url == "", part(source, 2)).otherwise(of_url)).otherwise(F.when(of_file == "", base).otherwise(of_file))


def disposition_name(header: Column) -> Column:
    """The file name of a content-disposition header; null if it has none."""
    found = F.regexp_extract(header, r"(?i)filename\*?=(?:UTF-8'')?\"?([^\";]+)", 1)
    return F.when(found == "", None).otherwise(F.coalesce(F.try_url_decode(F.regexp_replace(found, r"\+", "%2B")), found))
