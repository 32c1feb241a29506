"""Operator 6: line-first cleaning with a document verdict, in built-in functions only.

Every rule is an expression over one row, so a job reads the texts once and shuffles nothing, whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.common import let, table, words

#: Phrases that mark a short line as boilerplate.
BOILERPLATE = (
    "all rights reserved", "copyright (c)", "cookie policy", "uses cookies", "privacy policy", "terms of use",
    "terms of service", "enable javascript", "click here", "sign up for", "log in to", "subscribe to our",
    "lorem ipsum", "licensed under", "spdx-license-identifier",
)
BOILERPLATE_CHARS = 300
SENTENCE_END = r"""[.!?…]["'”’»)\]]*(\s|$)|[。！？]"""
SEPARATORS = r"[|»›•·]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
LOST_SHARE = 0.5


def _covered(hashes: Column) -> Column:
    """How many words lie in windows whose hash occurs twice or more; hashes holds one per window start."""

    def ends(ranked: Column) -> Column:
        same = lambda at, x: F.get(ranked, at)["h"].eqNullSafe(x["h"])
        marked = F.transform(ranked, lambda x, j: F.when(same(j - 1, x) | same(j + 1, x), x["i"]))
        return F.sort_array(F.array_compact(marked))

    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end"))
    return let(ranked, lambda r: F.aggregate(ends(r), start, step, lambda a: a["n"]))


def repeated_words(w: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the array w, first occurrence included."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))
    none = F.lit(0)
    return F.when(F.size(w) < WINDOW, none).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(_covered(h)))
    )


def line_fails(line: Column) -> Column:
    """True for a line with words that breaks the punctuation, navigation, symbol or boilerplate rule."""
    punctuation = ~line.rlike(SENTENCE_END)
    bars = F.regexp_count(line, F.lit(SEPARATORS))
    navigation = F.when(bars >= 3, bars * 4 >= F.size(words(line))).otherwise(F.lit(False))
    symbols = F.when(line.rlike(SYMBOLS), F.regexp_count(line, F.lit(SYMBOLS)) * 10 > F.length(line)).otherwise(F.lit(False))
    low = F.lower(line)
    phrases = F.lit(False)
    for p in BOILERPLATE:
        phrases = phrases | F.contains(low, F.lit(p))
    return punctuation | navigation | symbols | F.when(F.length(line) <= BOILERPLATE_CHARS, phrases).otherwise(F.lit(False))


def judge(text: Column) -> Column:
    """A struct for one text: counts, base_failed, kept, and clean_text (the lines that pass, joined by newlines)."""
    t = F.coalesce(text, F.lit(""))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")

    of_words = let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    total = lambda lines: F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x["line"]))
    of_lines = let(
        F.transform(
            F.filter(F.split(t, "\n"), has_word),
            lambda line: F.struct(line.alias("line"), line_fails(line).alias("fails")),
        ),
        lambda lines: F.struct(
            (F.size(lines) - F.size(F.array_distinct(F.transform(lines, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
            total(lines).cast("long").alias("line_chars"),
            total(F.filter(lines, lambda x: x["fails"])).cast("long").alias("lost_chars"),
            F.array_join(F.transform(F.filter(lines, lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("clean_text"),
        ),
    )
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda x: let(
            (x["w"]["n_words"] < 10) | (100 * x["w"]["n_repeat_words"] > 20 * x["w"]["n_words"]),
            lambda failed: F.struct(
                x["w"]["n_words"].alias("n_words"),
                x["w"]["word_chars"].alias("word_chars"),
                F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                x["l"]["n_dup_lines"].alias("n_dup_lines"),
                x["w"]["n_repeat_words"].alias("n_repeat_words"),
                failed.alias("base_failed"),
                (~failed & (x["l"]["lost_chars"] <= LOST_SHARE * x["l"]["line_chars"])).alias("kept"),
                x["l"]["lost_chars"].alias("lost_chars"),
                x["l"]["clean_text"].alias("clean_text"),
            ),
        ),
    )


def line_first_clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id as doc_id and the fields of judge().

    A null or empty text has no words, so it fails the base rules and its clean_text is empty. Repeated rows and
    ids are judged each on its own; a null id stays null. Other columns are dropped, so their names cannot clash.
    An empty table gives an empty table. Blank lines are left out of clean_text and count for nothing.
    """
    return docs.select(F.col(id_col).alias("doc_id"), judge(F.col(text_col)).alias("q")).select("doc_id", "q.*")


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_first_clean(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"
    )


_PHRASES = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)
_BLANK = r"[\x20\x09-\x0D]+"
OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_BLANK}'), lambda x: x <> '') AS w FROM d),
win AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
l AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT doc_id, line,
        NOT regexp_matches(line, '[.!?…]["''”’»)\]]*(\s|$)|[。！？]')
        OR (len(regexp_extract_all(line, '[|»›•·]')) >= 3
            AND len(regexp_extract_all(line, '[|»›•·]')) * 4 >= len(list_filter(regexp_split_to_array(line, '{_BLANK}'), lambda x: x <> '')))
        OR len(regexp_extract_all(line, '[#*$%&|<>]')) * 10 > length(line)
        OR (length(line) <= {BOILERPLATE_CHARS} AND ({_PHRASES})) AS fails FROM l),
per AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(length(line)) AS line_chars,
        coalesce(sum(length(line)) FILTER (WHERE fails), 0) AS lost_chars FROM f GROUP BY doc_id),
s AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(line_chars, 0) AS line_chars, coalesce(lost_chars, 0)::BIGINT AS lost_chars
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN per USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_chars <= {LOST_SHARE} * line_chars AS kept, lost_chars
FROM s
"""
