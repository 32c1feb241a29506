"""Operator 7: near-duplicate lines by a deletion-neighbourhood join, in built-in functions only.

A line is its words. Two lines are near if one word substituted, inserted or deleted turns one into the other and the
longer has at least five words (a fifth of it, at most); shorter lines must be equal. A line goes if an equal or near
line stands earlier in (doc_id, line number) order, kept or not.

Equal lines are first summed up to their earliest place. Lines that differ by one word share their first or their last
words, as many as the greatest power of two in half the shorter, so a line that shares neither end has no near line
and emits nothing. The others emit their deletion
variants as hashed keys: the xor of one hash per word and place, which a window adds up in linear time. A key's lines
are summed up to their earliest, never paired with each other, so a variant that a third of all lines share is a row
per line. The earliest partner is then compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.llm.common import let, stored, table, words

#: Least words of the longer line for one edit.
LEAST = 5
#: Kinds of keys: a line cut at a place, to meet lines cut at the same place; a line cut anywhere, and a whole line.
CUT_HERE, CUT, WHOLE = 0, 1, 2


def _lines(docs: DataFrame, id_col: str, text_col: str, also: tuple[str, ...]) -> DataFrame:
    text = F.col(text_col)
    more = [F.col(c).alias(f"also_{c}") for c in also]
    return docs.select(F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), *more).alias("doc"), F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"))


def _ends(w: Column) -> Column:
    """Keys of the ends that a line shares with a near one; two of them, or four where a word less has shorter ends."""
    n = F.size(w)
    p = lambda m: F.pow(2, F.floor(F.log2(m / 2) + 1e-9)).cast("int")
    of = lambda k: [F.xxhash64(F.lit("first"), k, F.slice(w, F.lit(1), k)), F.xxhash64(F.lit("last"), k, F.slice(w, n - k + 1, k))]
    both = F.when((n > LEAST - 1) & (p(n) != p(n - 1)), F.array(*of(p(n)), *of(p(n - 1)))).otherwise(F.array(*of(p(n))))
    return F.when(n >= LEAST - 1, both).otherwise(F.array().cast("array<bigint>"))


def _within_one(a: Column, b: Column) -> Column:
    """Whether word arrays a and b are one edit apart, or none."""
    common = lambda x, y: F.coalesce(F.nullif(F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False), F.lit(0)) - 1, F.least(F.size(x), F.size(y)).cast("long"))
    fore, aft = common(a, b), common(F.reverse(a), F.reverse(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (fore + aft >= F.greatest(F.size(a), F.size(b)) - 1)


def near_lines(first: DataFrame, docs: DataFrame) -> DataFrame:
    """Each distinct line (line, first, ends) that has an earlier near line.

    The lines in question get numbers, so two that share a 64-bit hash stay apart.
    Of the lines that share an end, words travel as 64-bit hashes. Keys travel without their lines' places until
    those that one line alone has are gone.
    """
    ends = first.select("line", F.explode("ends").alias("end"))
    shared = stored(ends.groupBy("end").agg(F.count("*").alias("n")).where("n > 1").select("end"))
    some = stored(ends.join(shared, "end", "left_semi").select("line").distinct())
    places = stored(first.select("line", "first").join(some, "line", "left_semi").withColumn("number", F.monotonically_increasing_id()))
    by_doc = places.groupBy("first.doc").agg(F.collect_list(F.struct("number", "first.no")).alias("found"))
    hashed = lambda x: F.struct(x["number"].alias("number"), F.transform(words(F.get("lines", x["no"])), lambda t: F.xxhash64(t)).alias("w"))
    # read by several consumers through one exchange, as is the exchange of the texts
    # rows of one document have equal lines; only one of each may be summed up
    alike = docs.join(by_doc, "doc").select(F.explode(F.transform("found", hashed)).alias("x")).select("x.number", "x.w").groupBy("number").agg(F.first("w").alias("w"))

    at = alike.select("number", F.size("w").alias("n"), F.posexplode("w").alias("at", "x"))
    at = at.select("number", "n", "at", F.xxhash64("x", "at").alias("a"), F.xxhash64("x", F.col("at") - 1).alias("b"))
    along = Window.partitionBy("number").orderBy("at")
    xor = lambda c, end: F.coalesce(F.expr(f"bit_xor({c})").over(along.rowsBetween(Window.unboundedPreceding, end)), F.lit(0).cast("long"))
    at = at.select("*", xor("a", Window.unboundedFollowing).alias("whole"), xor("a", -1).bitwiseXOR(xor("b", Window.unboundedFollowing)).bitwiseXOR(xor("b", Window.currentRow)).alias("cut"))
    key = lambda v, length, place, kind: F.struct(F.xxhash64(v, length, place).alias("k"), F.lit(kind).alias("kind"))
    none = F.array().cast("array<struct<k:bigint,kind:int>>")
    cuts = F.array(key("cut", F.col("n") - 1, F.col("at"), CUT_HERE), key("cut", F.col("n") - 1, F.lit(-1), CUT))
    keys = F.concat(F.when(F.col("n") >= LEAST, cuts).otherwise(none), F.when(F.col("at") == 0, F.array(key("whole", F.col("n"), F.lit(-1), WHOLE))).otherwise(none))
    keys = at.select("number", F.explode(keys).alias("x")).select("x.k", "x.kind", "number")
    common = keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    keys = keys.join(common, "k", "left_semi").join(places.drop("line"), "number").select("k", "kind", F.struct("first", "number").alias("at"))
    earliest = keys.groupBy("k").agg(F.min(F.when(F.col("kind") == WHOLE, F.col("at"))).alias("of_whole"), F.min(F.when(F.col("kind") != WHOLE, F.col("at"))).alias("of_cut"))
    partner = F.when(F.col("kind") == CUT, F.col("of_whole")).otherwise(F.col("of_cut"))
    pairs = keys.join(earliest, "k").select("at", partner.alias("partner")).where("partner.first < at.first")
    pairs = pairs.groupBy("at.number").agg(F.min("partner").alias("partner"))
    other = alike.select(F.col("number").alias("other"), F.col("w").alias("w2"))
    pairs = pairs.join(alike, "number").join(other, F.col("partner.number") == F.col("other"))
    return pairs.where(_within_one(F.col("w"), F.col("w2"))).select("number").join(places, "number").select("line")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, kept_lines (numbers from 0), clean_text and also, a row per input row.

    Lines without a word stay where they are and count for nothing. A null text has no lines and an empty
    clean_text. Rows with the same id and text are one document: each keeps what the document keeps. Rows that share
    only the id come in the order of a hash of their texts; null ids come first. The columns named by also, short and
    comparable, are part of a document's key and so come through without a shuffle of the texts more: rows that
    differ in them are different documents. Other columns are dropped. An empty table gives an empty table.
    """
    d = _lines(docs, id_col, text_col, also)
    row = lambda line, no: let(words(line), lambda w: F.struct(
        no.alias("no"), F.size(w).alias("n"), F.struct(F.xxhash64(w).alias("h1"), F.xxhash64(F.lit(7), w).alias("h2")).alias("line"), _ends(w).alias("ends"),
    ))
    lines = d.select("doc", F.explode(F.transform("lines", row)).alias("x")).where("x.n > 0")
    first = stored(lines.groupBy("x.line").agg(F.min(F.struct("doc", "x.no")).alias("first"), F.first("x.ends").alias("ends")))
    kept = first.select("line", "first").join(near_lines(first, d), "line", "left_anti")
    kept = kept.groupBy("first.doc").agg(F.collect_list("first.no").alias("kept"))
    out = d.join(kept, "doc", "left").withColumn("kept", F.sort_array(F.coalesce("kept", F.array().cast("array<int>"))))
    blank = F.filter(F.transform("lines", lambda x, i: F.when(~x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    out = out.withColumn("blank", blank)
    stay = F.transform(F.sort_array(F.concat("kept", "blank")), lambda i: F.get("lines", i))
    n_lines = (F.size("lines") - F.size("blank")).cast("long")
    return out.select(F.col("doc.doc_id").alias("doc_id"), n_lines.alias("n_lines"), (n_lines - F.size("kept")).alias("n_removed"), F.col("kept").alias("kept_lines"), F.array_join(stay, "\n").alias("clean_text"), *[F.col(f"doc.also_{c}").alias(c) for c in also])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "kept_lines", F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))
