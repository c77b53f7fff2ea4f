"""Text expressions of retrieval and ingestion: snippets, terms, classes, arithmetic."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnsift.functions.clean import strip

TOKEN = "[^\\p{L}\\p{N}]+"
# Words that an exploration query ignores.
STOPWORDS = (
    "what", "when", "where", "which", "who", "why", "how", "the", "and", "for", "with", "from", "this", "that", "these",
    "those", "are", "was", "has", "have", "had", "can", "will", "would", "should", "could", "may", "might", "does", "did",
    "about", "into", "over", "amp", "wire", "feet", "foot", "size", "type", "kind", "data", "page", "book", "text",
    "please", "tell", "show", "give", "find", "look", "search",
)


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), TOKEN, -1), lambda x: x != "")


def query_tokens(query: str, least: int = 1) -> list[str]:
    """Terms of a request, on the driver, by the rule of ``tokens``."""
    import regex

    return [t for t in regex.split(r"[^\p{L}\p{N}]+", query.lower()) if len(t) >= least and t]


def explore_terms(query: str) -> list[str]:
    """Terms of a request to explore from: distinct, four letters or more, no stop words."""
    return sorted({t.lower() for t in query.split() if len(t) >= 4 and t.lower() not in STOPWORDS})


def snippet(c: Column, most: int = 240) -> Column:
    s = F.replace(strip(c), F.lit("\n"), F.lit(" "))
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("…"))).otherwise(s)


def context_snippet(c: Column, query: str) -> Column:
    """80 characters before the first hit to 120 after it; without a hit, the snippet."""
    at = F.locate(query.lower(), F.lower(c))
    lo = F.greatest(at - 81, F.lit(0))
    hi = F.least(at - 1 + len(query) + 120, F.length(c))
    part = F.replace(strip(F.substring(c, lo + 1, hi - lo)), F.lit("\n"), F.lit(" "))
    cut = F.concat(
        F.when(lo > 0, "...").otherwise(""), part, F.when(hi < F.length(c), "...").otherwise("")
    )
    return F.when(at > 0, cut).otherwise(snippet(c))


def embed_input(summary: Column, text: Column) -> Column:
    return F.concat(summary, F.lit("\n\n"), F.substring(text, 1, 2000))


def summary_or_text(summary: Column, text: Column) -> Column:
    """Short texts are their own summary; a missing, empty or overlong one is cut text."""
    s = strip(summary)
    bad = s.isNull() | (s == "") | (F.length(s) > 600)
    return F.when(F.length(text) < 300, text).when(bad, F.substring(text, 1, 240)).otherwise(s)


def page_class(c: Column, least: int = 50) -> Column:
    return F.when(F.length(strip(c)) >= least, "digital_native").otherwise("scanned")


def document_class(digital: Column, pages: Column) -> Column:
    """digital_native or scanned from nine tenths of the pages, else hybrid."""
    return (
        F.when(pages == 0, "unknown")
        .when(digital >= 0.9 * pages, "digital_native")
        .when(pages - digital >= 0.9 * pages, "scanned")
        .otherwise("hybrid")
    )


def is_blank(c: Column, stddev: Column) -> Column:
    return F.when(F.length(strip(F.coalesce(c, F.lit("")))) > 20, F.lit(False)).otherwise(F.coalesce(stddev < 5.0, F.lit(False)))


def csv_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ",", -1), strip), lambda x: x != "")


def visual_progress(done: Column, total: Column) -> Column:
    return F.least(F.lit(99.0), 75 + 24.0 * done / total)


def entity_progress(done: Column, total: Column) -> Column:
    return F.least(F.lit(99.0), 88 + 11.0 * done / total)


def reduced_size(width: Column, height: Column, pct: int, least: int) -> tuple[Column, Column]:
    """Size of the reduced image: ``pct`` per cent, but a short side of ``least`` at least;
    images with a side below that stay."""
    w, h = F.floor(width * (pct / 100.0)), F.floor(height * (pct / 100.0))
    short = F.least(w, h)
    adjust = F.lit(float(least)) / short
    small = (width < least) | (height < least)

    def side(full: Column, cut: Column) -> Column:
        return F.when(small, full).when(short < least, F.ceil(cut * adjust)).otherwise(cut).cast("long")

    return side(width, w), side(height, h)


def chain(from_name: Column, from_label: Column, rel1: Column, hop1: Column, label1: Column, rel2: Column, hop2: Column, label2: Column) -> Column:
    """``A (L) → REL → B (L)``, and the second hop where there is one."""
    arrow = F.lit(" → ")
    one = F.concat(from_name, F.lit(" ("), from_label, F.lit(")"), arrow, rel1, arrow, hop1, F.lit(" ("), label1, F.lit(")"))
    two = F.concat(one, arrow, rel2, arrow, hop2, F.lit(" ("), label2, F.lit(")"))
    return F.when(hop2.isNotNull(), two).otherwise(one)


# Fixed value: how an answer cites pages.
CITATION = r"\[(?:#\s*\d+(?:\s*[,\-–]\s*#?\s*\d+)*|Pages?\s+[^\]]+)\]"


def citations(c: Column) -> Column:
    """The bracketed citations of an answer, in order."""
    return F.regexp_extract_all(c, F.lit(CITATION), F.lit(0))


def cited_pages(cite: Column) -> Column:
    return F.transform(F.regexp_extract_all(cite, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))


def query_text(c: Column, prefixed: bool) -> Column:
    """A query as the embedder wants it; one family of models takes task prefixes."""
    return F.concat(F.lit("search_query: "), c) if prefixed else c


def document_text(c: Column, prefixed: bool) -> Column:
    return F.concat(F.lit("search_document: "), c) if prefixed else c


def keyword_query(c: Column) -> Column:
    """The boosted phrase, or any of its words of two letters or more."""
    quoted = F.replace(c, F.lit('"'), F.lit('\\"'))
    words = F.filter(F.split(quoted, r"\s+", -1), lambda w: F.length(w) >= 2)
    phrase = F.concat(F.lit('"'), quoted, F.lit('"'))
    both = F.concat(phrase, F.lit("^4 OR ("), F.array_join(words, " OR "), F.lit(")"))
    return F.when(F.size(words) > 0, both).otherwise(phrase)


_JSON_PART = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.DOTALL)
_FENCE = re.compile(r"^```[^\n]*\n(.*?)(?:```)?$", re.DOTALL)


def balanced_object(text: str | None) -> str | None:
    """The first balanced JSON object of a model's answer, out of a code fence if it has one;
    braces within strings don't count."""
    if text is None:
        return None
    body = text.strip()
    if fenced := _FENCE.match(body):
        body = fenced[1].strip()
    start = body.find("{")
    depth = 0
    for part in _JSON_PART.finditer(body, start) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(part[0], 0)
        if depth == 0:
            return body[start : part.end()]
    return None


def first_json_object(c: Column | str) -> Column:
    """``balanced_object`` of a column, for from_json to parse."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(balanced_object)

    return run(c)
