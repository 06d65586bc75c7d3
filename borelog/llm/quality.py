"""Quality rules on lines and words, in DataFrame functions only.

A line (lower-cased, white space squeezed) that more than a set number of a host's documents hold is boilerplate. It is
removed, and a document that loses too large a part of its text is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_keys, meet, row_tag

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def lines_with_a_word(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), SPACE, " ")))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that the text holds twice or more, the first one included."""

    def covered(places: Column) -> Column:
        more = F.transform(F.slice(places, 2, F.size(places)), lambda p, i: F.least(F.lit(window), p - F.element_at(places, i + 1)))
        return F.when(F.size(places) == 0, F.lit(0)).otherwise(F.aggregate(more, F.lit(window), lambda a, x: a + x))

    def found(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            def twice(x: Column, i: Column) -> Column:
                before = F.when(i > 0, F.element_at(s, F.greatest(i, F.lit(1)))["h"] == x["h"])
                after = F.when(i + 1 < F.size(s), F.element_at(s, F.least(i + 2, F.size(s)))["h"] == x["h"])
                return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

            return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(ordered, places), covered))

    def hashes(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        return F.when(F.size(w) < window, F.array().cast("array<bigint>")).otherwise(keys)

    return let(let(words, hashes), found)


def base_columns(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """The base counts of a text, from its words and its lines that have one."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(words).cast("long"),
    }


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 20, max_share: float = 0.5, least_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """For every row: doc_id, the base counts, base_failed, n_removed (characters in removed lines), kept, and the text without them.

    A line is removed if more than ``max_docs`` documents of its host hold it; a document is rejected if it fails the base
    rules or removed lines hold more than ``max_share`` of the characters of its lines. A null text has no words and fails; a
    null host is a host; rows that repeat get the same verdict each and count as documents each; other columns are
    ignored; an empty table gives no rows; a very long text is one array of its words. Lines are counted before they are
    shuffled, a document's own repeats once; a line of very many documents is dealt over tasks. Only verdicts meet the
    documents again unless the text column is asked for."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))
    docs = docs.withColumn("doc", F.coalesce("doc_id", F.lit(-1))).withColumn("tag", F.concat(row_tag(F.col("doc_id"), F.col("text")), F.col("host").cast("binary")))
    sized = F.sort_array(F.transform(lines_with_a_word(F.col("text")), lambda x: F.struct(line_key(x).alias("line"), F.length(x).alias("chars"))))

    def each(s: Column) -> Column:
        """The sorted lines, each with whether it is the document's first with that key."""
        return F.transform(s, lambda x, i: F.struct(x["line"].alias("line"), x["chars"].alias("chars"), (F.coalesce(F.get(s, i - 1)["line"] != x["line"], F.lit(True))).alias("new")))

    lines = docs.select("doc", "tag", "host", F.explode(let(sized, each)).alias("x")).select("doc", "tag", "host", "x.line", "x.chars", "x.new")
    lines = cut(df.sparkSession, lines, "lines")
    common = lines.groupBy("host", "line").agg(F.count(F.when(F.col("new"), 1)).alias("docs"), F.count("*").alias("n")).where(F.col("docs") > max_docs)
    common = cut(df.sparkSession, common.select("host", "line", "n"), "common")
    lost = meet(lines, common.select("host", "line"), ["host", "line"], hot_keys(common, ["host", "line"]), ["doc", "tag"])
    lost = lost.groupBy("doc", "tag").agg(F.sum("chars").alias("lost"), F.collect_set("line").alias("gone"))
    split = docs.withColumns({"_words": word_list(F.col("text")), "_lines": lines_with_a_word(F.col("text"))})
    chars = F.aggregate("_lines", F.lit(0), lambda a, x: a + F.length(x))
    base = split.select("doc", "tag", "doc_id", "text", chars.alias("chars"), *[c.alias(k) for k, c in base_columns(F.col("text"), F.col("_words"), F.col("_lines")).items()])
    out = base.join(lost, ["doc", "tag"], "left")
    same = F.count("*").over(Window.partitionBy("doc", "tag"))  # rows equal in id and text have lost the sum of all
    out = out.withColumn("n_removed", (F.coalesce("lost", F.lit(0)) / same).cast("long"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.coalesce("gone", F.array().cast("array<bigint>")), line_key(x))), "\n")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(*cols, failed.alias("base_failed"), "n_removed", (~failed & (F.col("n_removed") <= max_share * F.col("chars"))).alias("kept"), left.alias("text"))


#: DuckDB SQL with judge()'s defaults over the table ``documents``.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host, row_number() OVER () AS r FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), l AS (
  SELECT r, host, x AS raw, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM (SELECT r, host, unnest(lines) AS x FROM w)
), f AS (
  SELECT host, line FROM l GROUP BY host, line HAVING count(DISTINCT r) > 20
), lost AS (
  SELECT l.r, sum(length(l.raw)) AS lost FROM l JOIN f USING (host, line) GROUP BY l.r
), g AS (
  SELECT r, i, list_slice(words, i, i + 7) AS g FROM (SELECT r, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w WHERE len(words) >= 8)
), rep AS (
  SELECT r, sum(coalesce(least(8, nxt - i), 8)) AS n FROM (
    SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1
  ) GROUP BY r
), b AS (
  SELECT w.r, w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(lost.lost, 0) AS lost, coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS chars
  FROM w LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       CAST(lost AS BIGINT) AS n_removed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= 0.5 * chars AS kept FROM b
"""
