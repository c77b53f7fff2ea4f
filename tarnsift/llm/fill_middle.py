"""Fill-in-middle: a text's lines are cut in prefix, middle and suffix and set in another order.

Built-in expressions only, one map stage over the scan: ``regexp_extract_all`` makes the lines,
eight-digit groups of a keyed SHA-256 of the doc_id choose cuts and form, slices of the lines
are joined into the arrangement, and splitting at the sentinels restores the text. No row looks
at another, so nothing is shuffled and a lost task is one partition of the scan again.

Defined cases: a null text counts as empty; an empty text, and one that holds a sentinel, is left
as it is (form ``plain``); a null doc_id hashes as an empty one; rows that repeat or share a doc_id
are arranged one by one, cut alike where their lines are as many; a text of one line has an empty
prefix, middle or suffix; a very long text is one row; an empty table gives an empty result;
further columns pass through ``arrange``, except that a column with the name of one it makes is
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINES = r"[^\n]*\n|[^\n]+"
SEED = 7
#: Of a hundred documents those that are arranged at all, and of these those with the suffix first.
RATE, SPM_RATE = 100, 50
OWN = ("n", "form", "prefix_chars", "middle_chars", "output")


def _number(digest: str, k: int) -> Column:
    """Group ``k`` (from 0) of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _once(df: DataFrame, names: list[str], made: dict[str, Column]) -> DataFrame:
    """Columns ``names`` of ``df`` and those of ``made``, each evaluated once per row: the
    optimizer doesn't copy expressions through ``inline``."""
    kept = [F.col(f"`{c}`") for c in names]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def arrange(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``docs`` (doc_id, text) with n lines, form, prefix_chars, middle_chars and output."""
    names = [c for c in docs.columns if c not in OWN]
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    one = _once(docs, names, {
        "__units": F.regexp_extract_all(text, F.lit(LINES), F.lit(0)),
        "__digest": F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256),
    })
    n = F.size("__units")
    cuts = [_number("__digest", k) % (n + 1) for k in (0, 1)]
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (n == 0) | marked | (_number("__digest", 2) % 100 >= rate)
    two = _once(one, [*names, "__units"], {
        "form": F.when(plain, "plain").when(_number("__digest", 3) % 100 < spm_rate, "spm").otherwise("psm"),
        "__a": F.least(*cuts).cast("int"),
        "__b": F.greatest(*cuts).cast("int"),
    })
    a, b = F.col("__a"), F.col("__b")
    part = lambda start, length: F.array_join(F.slice("__units", start, length), "")
    three = _once(two, [*names, "form"], {
        "n": n.cast("long"), "__p": part(F.lit(1), a), "__m": part(a + 1, b - a), "__s": part(b + 1, n - b),
    })
    form, p, m, s = (F.col(c) for c in ("form", "__p", "__m", "__s"))
    output = (
        F.when(form == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m))
        .when(form == "spm", F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
        .otherwise(F.concat(p, m, s))
    )
    chars = lambda c: F.when(form != "plain", F.length(c).cast("long"))
    return three.select(
        *[F.col(f"`{c}`") for c in names], "n", "form",
        chars(p).alias("prefix_chars"), chars(m).alias("middle_chars"), output.alias("output"),
    )


def restore(output: str = "output", form: str = "form") -> Column:
    """The text that an output of that form was made of. Only sentinels begin with ``<`` and end
    with ``>`` as they do, so none arises where pieces meet, and a split finds just those set."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(F.col(form) == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
        .when(F.col(form) == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
        .otherwise(F.col(output))
    )


def op12(docs: DataFrame) -> DataFrame:
    made = arrange(docs.select("doc_id", "text"))
    # The output is made once, and hashed and split from there.
    back = _once(made.drop("text"), ["doc_id", "n", "form", "prefix_chars", "middle_chars"], {"output": F.col("output")})
    return back.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(), 256).alias("restored_sha256"),
    )


def sql(source: str = "documents") -> str:
    """The query's rows in DuckDB's SQL, from ``source`` (doc_id, text)."""
    number = lambda k: f"('0x' || substr(digest, {8 * k + 1}, 8))::BIGINT"
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS digest,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM {source}
), h AS (
  SELECT *, len(u) AS n, {number(0)} % (len(u) + 1) AS c1, {number(1)} % (len(u) + 1) AS c2,
    {number(2)} AS h3, {number(3)} AS h4 FROM d
), c AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
    array_to_string(u[greatest(c1, c2) + 1:], '') AS s,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
      WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM h
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
    ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""
