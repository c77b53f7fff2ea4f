"""Quality rules: a threshold table compiled into one projection, no user functions.

Every figure is a built-in expression over one document, so the whole operator is one map
stage over the scan: no shuffle, no Python, and a long text costs n log n at worst.

Defined cases: a null text counts as the empty text; an empty text has no words and fails
the base rule; repeated rows and repeated doc_ids are judged one by one; an empty table gives
an empty result; further columns pass through ``apply_rules``, except that a column with the
name of a figure is replaced by the figure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsift.llm.common import BLANK_RUN, BLANKS

SYMBOLS = "#*$%&|<>"
WINDOW = 5

# The commonest function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are at from or an "
    "le la les de des du et en un une que qui dans pour sur par au aux est pas "
    "der die das und ist ein eine von zu mit den auf nicht im dem des sich für als "
    "el los las y que del se por con para una lo al su es"
).split()

#: name, figure (SQL over the columns below), comparison, bound. A document that meets any
#: line is rejected. Ratios are per word, per line or per character; n_* are counts.
RULES: tuple[tuple[str, str, str, float], ...] = (
    ("symbol_heavy", "n_symbols / greatest(n_words, 1)", ">", 0.1),
    ("shouting", "n_upper / greatest(word_chars, 1)", ">", 0.4),
    ("exclaiming", "n_marks / greatest(n_words, 1)", ">", 0.5),
    ("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", ">", 0.5),
    ("short_words", "word_chars / greatest(n_words, 1)", "<", 2.0),
    ("long_words", "word_chars / greatest(n_words, 1)", ">", 25.0),
    ("no_stop_words", "if(n_words >= 60, n_stop_words / n_words, 1.0)", "<", 0.01),
)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the
    figures that the threshold table needs (n_lines, n_upper, n_marks, n_stop_words)."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
           "n_upper", "n_marks", "n_stop_words"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    names = [c for c in docs.columns if c not in own]
    t = F.coalesce(F.col(text), F.lit(""))

    def gone(chars: str) -> Column:
        return F.length(t) - F.length(F.translate(t, chars, ""))

    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = docs.select(
        *kept,
        F.array_remove(F.split(t, BLANK_RUN, -1), "").alias("__words"),
        lines.alias("__lines"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        gone(SYMBOLS).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        gone("!").cast("long").alias("n_marks"),
    )
    figs = ["word_chars", "n_symbols", "n_upper", "n_marks"]
    n = F.size("__words")
    # A window is known by the chained 64-bit hash of its words, within one text only.
    two = one.select(
        *[F.col(f"`{c}`") for c in names], *figs,
        n.cast("long").alias("n_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(
            n >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), n - (WINDOW - 1)),
                lambda i: F.xxhash64(*[F.element_at("__words", i + k) for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")).alias("__hashes"),
    )
    figs += ["n_words", "n_lines", "n_dup_lines", "n_stop_words"]
    # Only a text with a repeated window is sorted.
    three = two.select(
        *[F.col(f"`{c}`") for c in names], *figs,
        F.when(
            F.size(F.array_distinct("__hashes")) < F.size("__hashes"),
            F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("__sorted"),
    )
    four = three.select(
        *[F.col(f"`{c}`") for c in names], *figs,
        F.sort_array(F.array_compact(F.transform(
            "__sorted",
            lambda x, k: F.when(
                (F.get(F.col("__sorted"), k - 1)["h"] == x["h"])
                | (F.get(F.col("__sorted"), k + 1)["h"] == x["h"]),
                x["i"],
            ),
        ))).alias("__starts"),
    )
    covered = F.aggregate(
        "__starts",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, s: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), s - a["last"])).cast("long").alias("n"), s.alias("last")
        ),
        lambda a: a["n"],
    )
    # inline() of a single row keeps a later filter on a figure from being pushed below, where
    # it would copy the expressions above it into lambdas and evaluate them once per word.
    return four.select(
        *[F.col(f"`{c}`") for c in names],
        F.inline(F.array(F.struct(*figs, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words")))),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(rules: tuple[tuple[str, str, str, float], ...] = RULES) -> Column:
    """The table as one expression: the names of the lines that a document meets."""
    return F.array_compact(
        F.array(*[F.when(F.expr(f"({fig}) {op} {bound}"), F.lit(name)) for name, fig, op, bound in rules])
    )


def apply_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with its figures, ``failed_rules``, ``base_failed`` and ``kept``."""
    own = ("failed_rules", "base_failed", "kept")
    m = measure(docs.drop(*own))
    return m.withColumns({"base_failed": base_failed(), "failed_rules": verdict(rules)}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )


def op2(docs: DataFrame) -> DataFrame:
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return apply_rules(docs.select("doc_id", "text")).select("doc_id", *cols)


def sql(source: str = "documents", rules=RULES) -> str:
    """The query's rows in DuckDB's SQL, from ``source`` (doc_id, text)."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    met = " OR ".join(f"({fig.replace('if(', 'IF(')}) {op} {bound}" for _, fig, op, bound in rules)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM {source}
), w AS (
  SELECT k, doc_id, t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT k, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5
), h AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, ws[i], ws[i+1], ws[i+2], ws[i+3], ws[i+4]) AS c FROM g
), cover AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM h WHERE c > 1) GROUP BY k
), f AS (
  SELECT w.k, doc_id,
    len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(ls)::BIGINT AS n_lines,
    len(regexp_extract_all(t, '\p{{Lu}}'))::BIGINT AS n_upper,
    (length(t) - length(translate(t, '!', '')))::BIGINT AS n_marks,
    len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN cover c ON c.k = w.k
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce({met}, false) AS kept
FROM b
"""
