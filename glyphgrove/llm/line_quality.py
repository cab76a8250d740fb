"""Quality rules: lines frequent across the documents of a host, and simple counts. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgrove.runtime import materialise

WORD = "[^\\x20\\x09-\\x0D]+"
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Words a document needs, and the share of its words (percent) that repeated windows may make up.
MIN_WORDS, MAX_REPEATED = 50, 50
#: A line is frequent on a host if more of its distinct texts hold it than this number, however many texts it
#: has; a document is depleted if frequent lines leave it fewer than this percent of its words.
LINE_DOCS, LEFT_PERCENT = 20, 50


def _keyed(docs: DataFrame, text: str, host: str, *more: Column) -> DataFrame:
    """Rows with the text (null: empty), the host without nulls, and a key of the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    place = F.concat(F.when(F.col(host).isNull(), "0").otherwise("1"), F.coalesce(F.col(host).cast("string"), F.lit("")))
    return docs.select(
        *more, body.alias("_text"), place.alias("_host"),
        F.xxhash64(body).alias("_hash"), F.length(body).alias("_chars"))


def _normal(line: Column) -> Column:
    """Lower case, digits alike, single spaces: what makes two lines the same across documents."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), "[\\x20\\x09-\\x0D]+", " "))


def base_counts(rows: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of ``_text`` to each row."""
    words = rows.select("*", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"))
    n = F.size("_words")
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(at, lambda i: F.xxhash64(
        F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = words.select(
        "*", n.cast("long").alias("n_words"), windows.alias("_windows"), lines.alias("_lines"))
    # only a text that holds a window twice needs its windows in order
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    tagged = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    sorted_ = counted.select("*", F.when(twice, F.array_sort(tagged)).alias("_sorted"))
    again = F.filter("_sorted", lambda x, i: (
        F.coalesce(F.get("_sorted", i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False))))
    inside = F.array_distinct(F.flatten(F.transform(
        again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return sorted_.select(
        *rows.columns, "n_words",
        F.length(F.translate("_text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_sorted").isNull(), F.lit(0)).otherwise(F.size(inside)).cast("long").alias("n_repeat_words"),
    )


def frequent_lines(
    docs: DataFrame, text: str = "text", host: str = "source",
    line_docs: int = LINE_DOCS,
) -> DataFrame:
    """(_host, _hash, _chars, removed_words, removed): the frequent lines of each text that has some.

    ``removed`` holds the hashes of its normalised lines that are frequent on its host, ``removed_words``
    the words of all their occurrences in the text. Copies of a text count once. The texts are split into lines
    once and the table of lines is written. A line met in a third of all texts is added up inside tasks first, then its
    one count is joined to the lines.
    """
    rows = _keyed(docs, text, host)
    line = F.explode(F.filter(F.split("_text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    lines = rows.select("_host", "_hash", "_chars", line.alias("_line")).select(
        "_host", "_hash", "_chars", F.xxhash64(_normal(F.col("_line"))).alias("_key"),
        F.regexp_count("_line", F.lit(WORD)).alias("_n"))
    # copies of a text come together here; only how many words one of them holds is kept
    held = materialise(lines.groupBy("_host", "_key", "_hash", "_chars").agg(F.sum("_n").alias("_all")), "lines")
    texts = rows.groupBy("_host", "_hash", "_chars").agg(F.count(F.lit(1)).alias("_copies"))
    common = held.groupBy("_host", "_key").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") > line_docs)
    found = held.join(common.select("_host", "_key"), ["_host", "_key"])
    per_text = found.groupBy("_host", "_hash", "_chars").agg(
        F.sum("_all").alias("_all"), F.sort_array(F.collect_list("_key")).alias("removed"))
    return per_text.join(texts, ["_host", "_hash", "_chars"]).select(
        "_host", "_hash", "_chars", (F.col("_all") / F.col("_copies")).cast("long").alias("removed_words"), "removed")


def judge(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source",
    line_docs: int = LINE_DOCS, left_percent: int = LEFT_PERCENT,
) -> DataFrame:
    """Return (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, left_words, kept).

    ``base_failed``: fewer than ``MIN_WORDS`` words, or more than ``MAX_REPEATED`` percent of them in 3-word
    windows met twice. Otherwise a document is kept if its words without the frequent lines are at least
    ``MIN_WORDS`` and ``left_percent`` percent of all. A line is frequent if more than ``line_docs`` of the host's
    distinct texts hold it, so texts without it change nothing. Null and empty texts have no words and fail. Null hosts form one host. Repeated rows and null ids are judged by their text like others. Extra
    columns are ignored; no rows give no rows.
    """
    counts = base_counts(_keyed(docs, text, host, F.col(id_column).cast("long").alias("doc_id")))
    counts = counts.drop("_text")
    lines = frequent_lines(docs, text, host, line_docs).drop("removed")
    joined = counts.join(lines, ["_host", "_hash", "_chars"], "left")
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), left.alias("left_words"),
        (~failed & (left >= MIN_WORDS) & (100 * left >= left_percent * F.col("n_words"))).alias("kept"))


def without_frequent_lines(
    docs: DataFrame, text: str = "text", host: str = "source",
    line_docs: int = LINE_DOCS,
) -> DataFrame:
    """``docs`` with the frequent lines taken out of ``text``; null texts stay null, no row goes."""
    found = frequent_lines(docs, text, host, line_docs).select(
        F.struct("_host", "_hash", "_chars").alias("_place"), "removed")
    body = F.coalesce(F.col(text), F.lit(""))
    place = F.concat(F.when(F.col(host).isNull(), "0").otherwise("1"), F.coalesce(F.col(host).cast("string"), F.lit("")))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.struct(
        place.alias("_host"), F.xxhash64(body).alias("_hash"), F.length(body).alias("_chars")).alias("_place"))
    joined = own.join(found, "_place", "left")
    kept = F.array_join(F.filter(
        F.split(F.col("_doc")[text], "\n", -1),
        lambda x: ~F.coalesce(F.array_contains("removed", F.xxhash64(_normal(x))), F.lit(False))), "\n")
    return joined.select(*[
        (F.when(F.col("removed").isNull(), F.col("_doc")[c]).otherwise(kept) if c == text else F.col("_doc")[c]).alias(c)
        for c in docs.columns])


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce('1' || source, '0') AS host FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
l AS (SELECT *, list_filter(ls, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lw FROM w),
texts AS (SELECT host, t, any_value(lw) AS lw, any_value(len(ws)) AS n FROM l GROUP BY host, t),
lines AS (
  SELECT host, t, trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS k,
         len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS n
  FROM (SELECT host, t, unnest(lw) AS x FROM texts)),
common AS (
  SELECT host, k FROM (SELECT host, k, count(DISTINCT t) AS docs FROM lines GROUP BY host, k) WHERE docs > {LINE_DOCS}),
removed AS (SELECT host, t, sum(n) AS gone FROM lines JOIN common USING (host, k) GROUP BY host, t),
windows AS (
  SELECT host, t, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM (SELECT host, t, ws, unnest(range(1, len(ws) - 1)) AS i FROM (SELECT DISTINCT host, t, ws FROM w))),
twice AS (
  SELECT host, t, i FROM (SELECT *, count(*) OVER (PARTITION BY host, t, win) AS c FROM windows) WHERE c > 1),
repeated AS (
  SELECT host, t, count(DISTINCT j) AS r FROM (SELECT host, t, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY host, t),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lw) - len(list_distinct(lw)))::BIGINT AS n_dup_lines,
         coalesce(r, 0)::BIGINT AS n_repeat_words, (len(ws) - coalesce(gone, 0))::BIGINT AS left_words
  FROM l LEFT JOIN repeated USING (host, t) LEFT JOIN removed USING (host, t)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND left_words >= {MIN_WORDS} AND 100 * left_words >= {LEFT_PERCENT} * n_words AS kept FROM f
"""
