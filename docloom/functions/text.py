"""Words, token estimates, lexical terms, headings and set overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the pieces and trims: ASCII, no-break space, byte order mark and Unicode's spaces.
SPACE = r"[\s\u000B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def trimmed(text: Column) -> Column:
    """Both ends without white space. The look-behind keeps the search for the end from starting anew within a run."""
    return F.regexp_replace(text, f"^{SPACE}+|(?<!{SPACE}){SPACE}+$", "")


def normal_lines(text: Column) -> Column:
    """Line ends as \\n, both ends trimmed."""
    return trimmed(F.regexp_replace(text, r"\r\n?", "\n"))


def pieces(text: Column) -> Column:
    """Pieces between runs of white space, empty ones at the ends counted."""
    return F.regexp_count(text, F.lit(f"{SPACE}+")) + 1


def word_count(text: Column) -> Column:
    """0 for blank or null text. Pieces less the empty ones at the ends."""
    t = F.coalesce(text, F.lit(""))
    first, last = F.substring(t, 1, 1).rlike(SPACE).cast("int"), F.substring(t, -1, 1).rlike(SPACE).cast("int")
    return F.when(t == "", 0).otherwise(pieces(t) - first - last).cast("long")


def token_estimate(text: Column) -> Column:
    """A fourth of the characters, rounded up: what chunks are stored with."""
    return F.ceil(F.length(text) / 4).cast("long")


def billed_tokens(text: Column) -> Column:
    """Three quarters of the pieces between white space, empty ones counted, rounded up: what usage is billed by."""
    return F.ceil(pieces(text) * 0.75).cast("long")


def heading(text: Column, fallback: Column | None = None) -> Column:
    """The first line if it is up to 120 characters long and starts with # or a capital; else the fallback."""
    line = trimmed(F.split(text, "\n")[0])
    return F.when((F.length(line) <= 120) & line.rlike("^[#A-Z]"), line).otherwise(F.lit(None) if fallback is None else fallback)


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ascii_tokens(text: Column) -> Column:
    """Distinct lower-case ASCII tokens, for set overlap."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; 0 if either is empty."""
    both, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / every)


def squeezed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, f"{SPACE}+", " "))


def shortened(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def query_terms(query: str) -> list[str]:
    """The prefixes a query asks for: pieces between white space less the operators' characters. Raises if none is left."""
    found = [x for x in (piece.translate({ord(c): None for c in "':*&|!()"}) for piece in query.split()) if x]
    if not found:
        raise ValueError("query has no usable search terms")
    return found


def prefix_query(query: str) -> str:
    return " & ".join(f"{t}:*" for t in query_terms(query))


def occurrences(text: Column, terms_: list[str]) -> Column:
    """How often the terms of more than two characters occur in the lower-case text, as substrings."""
    low = F.lower(text)
    counts = [((F.length(low) - F.length(F.replace(low, F.lit(t.lower()), F.lit("")))) / len(t)).cast("long") for t in terms_ if len(t) > 2]
    return sum(counts, F.lit(0).cast("long"))
