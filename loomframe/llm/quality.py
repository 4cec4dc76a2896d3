"""Quality rules: per-text measures, and lines that too many documents of one host share.

DataFrame functions only. The measures of a text (words, repeated words, repeated lines, symbols) come from its own arrays.
Then lines are compared across documents: normalised lines (lower case, outer white space off, digits as 0) are hashed, and
for each host (the `source` column) the different documents that have a line are counted. Documents are the same where their texts are
equal to the last character: copies count once, among those that have a line and among the host's documents alike. A line is removed where
more than `MIN_DOCS` different documents, and more than `SHARE` of the host's different documents, have it. A document is depleted, and rejected, if removed lines leave it under `LEAST_WORDS` words or under
`LEAST_LEFT` of its words.

A host has at most 1 / SHARE times its mean number of lines per document of such lines, so the lists of them are short; they are
written and joined by host (Spark broadcasts them while they are small and joins with skew handling beyond that).

Nulls: a null text has no words and fails; a null source is one host of its own (''). Repeated rows are one document and
are judged alike. Empty tables give no rows. Columns whose names clash with our own (leading `_q_`) are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

MIN_DOCS = 20
SHARE = 0.05
LEAST_WORDS = 50
LEAST_LEFT = 0.3
#: Low bits of a window's key that hold its position; longer texts take the plain way.
POSITION_BITS = 21

_SPACE = " \t\n\x0b\x0c\r"
_SPACE_RE = "[\\x20\\x09-\\x0D]+"


def _stripped(c: Column) -> Column:
    return F.trim(c, F.lit(_SPACE))


def words(text: Column) -> Column:
    """The white-space separated words of a text, none for null."""
    inner = _stripped(text)
    return F.when(F.length(inner) > 0, F.split(inner, _SPACE_RE)).otherwise(F.array().cast("array<string>"))


def _line_hash(line: Column) -> Column:
    return F.substring(F.md5(F.regexp_replace(F.lower(_stripped(line)), "[0-9]", "0").cast("binary")), 1, 16)


def with_repeat_words(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: how many words of _q_w stand in a three-word window that the text has at least twice.

    Windows are sorted by a key of hash and position; only neighbours with equal hashes are compared word by word. Should windows
    with one hash differ in words (or the text be too long for the key), windows are sorted by their words instead. Every step is
    a projection of its own, so that no array is worked out twice.
    """
    low = (1 << POSITION_BITS) - 1
    w, names = F.col("_q_w"), df.columns
    windows = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
    keys = F.transform(windows, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    alike = lambda x, y: F.shiftrightunsigned(x.bitwiseXOR(y), POSITION_BITS) == F.lit(0).cast("long")

    def equal(x, y):
        i, j = x.bitwiseAND(F.lit(low)).cast("int"), y.bitwiseAND(F.lit(low)).cast("int")
        return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    step = df.select(*names, F.sort_array(keys).alias("_q_k"))
    step = step.select(*names, F.filter("_q_k", lambda x, i: alike(x, F.get("_q_k", i + 1)) | alike(x, F.get("_q_k", i - 1))).alias("_q_k"))
    clash = F.exists(F.transform("_q_k", lambda x, i: alike(x, F.get("_q_k", i + 1)) & ~equal(x, F.get("_q_k", i + 1))), lambda b: F.coalesce(b, F.lit(False)))
    step = step.select(*names, "_q_k", ((F.size(w) > low) | ((F.size("_q_k") > 0) & clash)).alias("_q_plain"))
    rows = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.cast("long").alias("p"))))
    step = step.select(*names, "_q_k", F.when(F.col("_q_plain"), rows).alias("_q_rows"))
    plain = F.transform(F.filter("_q_rows", lambda x, i: _same(x, F.get("_q_rows", i - 1)) | _same(x, F.get("_q_rows", i + 1))), lambda x: x["p"])
    step = step.select(*names, F.when(F.col("_q_rows").isNotNull(), plain).otherwise(F.transform("_q_k", lambda x: x.bitwiseAND(F.lit(low)))).alias("_q_at"))
    each = F.flatten(F.array("_q_at", F.transform("_q_at", lambda p: p + 1), F.transform("_q_at", lambda p: p + 2)))
    return step.select(*names, F.size(F.array_distinct(each)).cast("long").alias("n_repeat_words"))


def _same(x: Column, y: Column) -> Column:
    return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures and base_failed, and what the comparison across documents needs (_q_ columns)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_q_host"), text.alias("_q_text"))
    read = read.select("doc_id", "_q_host", "_q_text", words(F.col("_q_text")).alias("_q_w"), F.filter(F.split("_q_text", "\n"), lambda x: F.length(_stripped(x)) > 0).alias("_q_l"))
    return (
        with_repeat_words(read).select(
            "doc_id", "_q_host", _sign(F.col("_q_text")).alias("_q_sign"),
            F.size("_q_w").cast("long").alias("n_words"),
            F.length(F.array_join("_q_w", "")).cast("long").alias("word_chars"),
            (F.length("_q_text") - F.length(F.regexp_replace("_q_text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long").alias("n_dup_lines"),
            "n_repeat_words",
            F.transform("_q_l", lambda x: F.struct(_line_hash(x).alias("h"), F.size(words(x)).alias("n"))).alias("_q_lines"),
        )
        .withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    )


def _sign(text: Column) -> Column:
    """What makes two documents one: the whole text as it is."""
    return F.md5(text.cast("binary"))


def frequent_lines(lines: DataFrame) -> DataFrame:
    """_q_host and _q_cut, the hashes of its lines above the limits, from rows of _q_host, _q_sign and _q_lines."""
    each = lines.select("_q_host", "_q_sign", F.explode(F.array_distinct(F.transform("_q_lines", lambda x: x["h"]))).alias("_q_h"))
    docs = lines.groupBy("_q_host", "_q_sign").agg(F.lit(1).alias("_q_1")).groupBy("_q_host").agg(F.count("*").alias("_q_docs"))
    having = each.groupBy("_q_host", "_q_h", "_q_sign").agg(F.lit(1).alias("_q_1"))
    counted = having.groupBy("_q_host", "_q_h").agg(F.count("*").alias("_q_n")).where(F.col("_q_n") > MIN_DOCS)
    return counted.join(docs, "_q_host").where(F.col("_q_n") > F.lit(SHARE) * F.col("_q_docs")).groupBy("_q_host").agg(F.collect_list("_q_h").alias("_q_cut"))


def judge(measured: DataFrame) -> DataFrame:
    """Add words_removed, depleted and kept to a written table of measures."""
    cut = written(frequent_lines(measured), "lines")
    removed = F.aggregate(F.filter("_q_lines", lambda x: F.array_contains(F.col("_q_hit"), x["h"])), F.lit(0), lambda a, x: a + x["n"])
    return (
        measured.join(cut, "_q_host", "left")
        .withColumn("_q_hit", F.array_intersect(F.transform("_q_lines", lambda x: x["h"]), "_q_cut"))  # by hash, so that lines are not compared with the whole list
        .withColumn("words_removed", F.when(F.col("_q_cut").isNull(), 0).otherwise(removed).cast("long"))
        .withColumn("depleted", (F.col("words_removed") > 0) & ((F.col("n_words") - F.col("words_removed") < LEAST_WORDS) | (F.col("n_words") - F.col("words_removed") < F.lit(LEAST_LEFT) * F.col("n_words"))))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )


def assess(docs: DataFrame) -> DataFrame:
    """One row for each document: measures, base_failed, words_removed, depleted, kept."""
    return judge(written(measures(docs), "measures")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_removed", "depleted", "kept")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, all their columns, texts without the removed lines; n_chars follows the text if there is one."""
    names = docs.columns
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_q_row"), F.col("text").cast("string").alias("text"), F.col("source"), F.lit(None).cast("long").alias("doc_id"))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = carried.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_q_host"),
        _sign(text).alias("_q_sign"),
        F.transform(F.filter(F.split(text, "\n"), lambda x: F.length(_stripped(x)) > 0), lambda x: F.struct(_line_hash(x).alias("h"), F.lit(0).alias("n"))).alias("_q_lines"),
    )
    cut = written(frequent_lines(lines), "lines")
    none = F.array().cast("array<string>")
    joined = carried.withColumn("_q_host", F.coalesce(F.col("source").cast("string"), F.lit(""))).join(cut, "_q_host", "left").withColumn("_q_cut", F.coalesce("_q_cut", none))
    hit = F.array_intersect(F.transform(F.split(text, "\n"), _line_hash), "_q_cut")
    parts = joined.withColumn("_q_hit", F.when(F.size("_q_cut") == 0, none).otherwise(hit)).select(
        "_q_row", text.alias("_q_text"), words(text).alias("_q_w"),
        F.when(F.size("_q_hit") == 0, text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("_q_hit"), _line_hash(x))), "\n")).alias("_q_left"),
    )
    parts = with_repeat_words(parts).select("_q_row", "_q_left", "n_repeat_words", F.size("_q_w").alias("_q_n"), F.size(words(F.col("_q_left"))).alias("_q_m"))
    n, left = F.col("_q_n"), F.col("_q_m")
    good = (n >= 50) & (F.col("n_repeat_words") * 100 <= n * 50) & ((left == n) | ((left >= LEAST_WORDS) & (left >= F.lit(LEAST_LEFT) * n)))
    now = {"text": F.col("_q_left"), "n_chars": F.length("_q_left").cast("long")}
    row = F.struct(*[now.get(c, F.col(f"_q_row.`{c}`")).alias(c) for c in names])
    # Written, as Spark would push a filter on the verdict below its steps and repeat them.
    return written(parts.select(row.alias("_q_row"), good.alias("_q_good")), "judged").where("_q_good").select(*[F.col(f"_q_row.`{c}`").alias(c) for c in names])


def sql() -> str:
    """DuckDB SQL for assess()."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
ln AS (SELECT r, host, unnest(string_split(t, chr(10))) AS l FROM d),
l AS (SELECT r, host, l, substr(md5(regexp_replace(lower(trim(l, {_sql_space()})), '[0-9]', '0', 'g')), 1, 16) AS h,
        len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS n FROM ln WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
p AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i+1], w[i+2]) AS c FROM p),
c AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i+1, i+2]) AS k FROM g WHERE c > 1) GROUP BY r),
dup AS (SELECT r, sum(c - 1) AS n FROM (SELECT r, l, count(*) AS c FROM l GROUP BY r, l) GROUP BY r),
sg AS (SELECT r, host, md5(t) AS s FROM d),
cnt AS (SELECT l.host, l.h, count(DISTINCT sg.s) AS n FROM l JOIN sg USING (r) GROUP BY l.host, l.h),
hs AS (SELECT host, count(DISTINCT s) AS n FROM sg GROUP BY host),
cut AS (SELECT cnt.host, cnt.h FROM cnt JOIN hs USING (host) WHERE cnt.n > {MIN_DOCS} AND cnt.n > {SHARE}::DOUBLE * hs.n),
rem AS (SELECT l.r, sum(l.n) AS n FROM l JOIN cut USING (host, h) GROUP BY l.r),
m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(rem.n, 0)::BIGINT AS words_removed
      FROM w LEFT JOIN c USING (r) LEFT JOIN dup USING (r) LEFT JOIN rem USING (r)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        words_removed > 0 AND (n_words - words_removed < {LEAST_WORDS} OR n_words - words_removed < {LEAST_LEFT}::DOUBLE * n_words) AS depleted FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_removed, depleted, NOT base_failed AND NOT depleted AS kept FROM j
"""


def _sql_space() -> str:
    return "' ' || " + " || ".join(f"chr({ord(c)})" for c in _SPACE[1:])
