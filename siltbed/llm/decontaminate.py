"""Operator 9: benchmark decontamination by a positional inverted index, in built-in functions only.

Test windows are looked up from their rarest terms: postings (term, document, position) are stored for the two
terms of each window that the fewest documents have, the two lists are shifted by the terms' offsets and
intersected, and what remains is compared word by word with the context stored beside the rarest term's posting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.common import ascii_lower, cut, table

#: Fixed value of the contract, for texts whose A-Z may still be upper-case.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A set of at most so many terms goes into the plan as literals; a larger one is joined.
MOST_LITERALS = 100_000
SALTS = 32


def exact_words(text: Column) -> Column:
    """Words with their case; A-Z is lowered only where words are compared."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD), "")


def _tokens(docs: DataFrame, terms: DataFrame, most_literals: int, distinct: bool, reach: int = 0) -> DataFrame:
    """Tokens of docs (key, w) that are among terms (term): key, term, pos, n, and ctx, the words within reach.

    Terms are compared in lower case of any alphabet, which is coarser than the contract's, so no match is lost.
    """
    known = [r[0] for r in terms.limit(most_literals + 1).collect()]
    lowered = F.transform("w", lambda x: F.lower(x))
    if distinct:
        listed = F.transform(F.array_distinct(lowered), lambda t: F.struct(t.alias("term")))
    else:
        listed = F.transform(lowered, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    joined = len(known) > most_literals
    if not joined:
        listed = F.filter(listed, lambda x: x["term"].isin(known) if known else F.lit(False))
    if not distinct:
        listed = F.transform(
            listed,
            lambda x: F.struct(
                x["term"].alias("term"), x["pos"].alias("pos"), F.size("w").alias("n"), F.greatest(x["pos"] - reach, F.lit(0)).alias("lo"),
                F.slice("w", F.greatest(x["pos"] - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("ctx"),
            ),
        )
    out = docs.select("key", F.explode(listed).alias("t")).select("key", "t.*")
    return out.join(terms, "term") if joined else out


def find_matches(docs: DataFrame, items: DataFrame, n: int = 13, slack: int = 0, most_literals: int = MOST_LITERALS) -> DataFrame:
    """Where windows of items (item_id, w) occur in docs (key, w): key, start, length, items, kind.

    kind 'exact': the words are the window's, in order. With slack > 0 also kind 'near': the two rarest terms lie
    within slack of their distance in the window, and all its terms within slack of its span. start counts from 0.
    """
    length = F.least(F.lit(n), F.size("w"))
    windows = items.where(F.size("w") > 0).select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - length), lambda i: F.slice("w", i + 1, length))).alias("ws"))
    windows = windows.select("item_id", F.transform("ws", ascii_lower).alias("ws")).groupBy("ws").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    windows = cut(windows.withColumn("wid", F.xxhash64("ws", F.lit(1))))
    placed = windows.select("wid", F.posexplode(F.transform("ws", lambda t: F.lower(t))).alias("off", "term"))

    seen = _tokens(docs, placed.select("term").distinct(), most_literals, True).groupBy("term").agg(F.count("*").alias("df"))
    probes = placed.join(seen, "term", "left").groupBy("wid").agg(
        F.count_if(F.col("df").isNull()).alias("absent"), F.slice(F.sort_array(F.collect_list(F.struct("df", "off", "term"))), 1, 2).alias("rare")
    )
    probes = probes if slack else probes.where("absent = 0")
    probes = probes.where("size(rare) > 0").select("wid", F.col("rare")[0].alias("a"), F.coalesce(F.get("rare", F.lit(1)), F.col("rare")[0]).alias("b"))
    probes = cut(probes.join(windows, "wid"))
    terms = probes.select(F.explode(F.array("a.term", "b.term")).alias("term")).distinct()
    reach = n - 1 + slack
    postings = cut(_tokens(docs, terms, most_literals, False, reach))

    # a frequent term's postings are dealt out over SALTS keys; the windows, few beside them, go to each
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    postings = postings.withColumn("salt", F.pmod(F.xxhash64("key", "pos"), F.lit(SALTS)).cast("int"))
    first = postings.join(probes.select("wid", "ws", "items", F.col("a.term").alias("term"), F.col("a.off").alias("off"), salts), ["term", "salt"])
    first = first.select("key", "wid", (F.col("pos") - F.col("off")).alias("start"), "ws", "items", "n", "lo", "ctx")
    second = postings.join(probes.select("wid", F.col("b.term").alias("term"), F.col("b.off").alias("off"), salts), ["term", "salt"])
    second = second.select("key", "wid", (F.col("pos") - F.col("off")).alias("start"))
    inside = (F.col("start") >= 0) & (F.col("start") + F.size("ws") <= F.col("n"))
    exact = first.where(inside).join(second, ["key", "wid", "start"], "left_semi")
    part = F.transform(F.slice("ctx", F.greatest(F.col("start") - F.col("lo"), F.lit(0)) + 1, F.size("ws")), ascii_lower)
    out = exact.where(part == F.col("ws")).select("key", "start", F.size("ws").alias("length"), "items", F.lit("exact").alias("kind"))
    if slack:
        bucket = F.floor(F.col("start") / (slack + 1))
        close = second.select("key", "wid", F.col("start").alias("at"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
        near = first.withColumn("bucket", bucket).join(close, ["key", "wid", "bucket"]).where(F.abs(F.col("start") - F.col("at")) <= slack)
        low = F.greatest(F.col("start") - slack, F.lit(0))
        wide = F.transform(F.slice("ctx", F.greatest(low - F.col("lo"), F.lit(0)) + 1, F.size("ws") + 2 * slack), ascii_lower)
        near = near.where((F.size(F.array_except("ws", wide)) == 0) & ~(inside & (part == F.col("ws"))))
        out = out.unionByName(near.select("key", "start", F.size("ws").alias("length"), "items", F.lit("near").alias("kind"))).distinct()
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", most_literals: int = MOST_LITERALS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted as strings) and contaminated, a row per input row.

    benchmark has item_id and text. Null and empty texts have no words; a null item_id counts as no item but its
    windows still hit. Rows that share id and text get the same result; rows that share only the id are kept
    apart. Other columns are dropped. An empty benchmark leaves every document clean.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), exact_words(F.col(text_col)).alias("w"))
    base = base.select(F.struct("doc_id", "h").alias("key"), "w")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), exact_words(F.col("text")).alias("w"))
    found = find_matches(base, items, n, most_literals=most_literals)
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(x["end"], a["end"]).alias("end"))
    hits = found.groupBy("key").agg(spans.alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    hits = hits.select("key", F.aggregate("spans", zero, step, lambda a: a["n"]).cast("long").alias("n_hit"), "item_ids")
    out = base.select("key", F.size("w").cast("long").alias("n_words")).join(hits, "key", "left")  # fields of a struct key match null to null
    out = out.select(F.col("key.doc_id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, i + 1, i + least(13, len(w))) AS g FROM (SELECT item_id, w, unnest(range(len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) AS l FROM win),
dw AS (SELECT doc_id, i, l, list_slice(w, i + 1, i + l) AS g FROM (SELECT doc_id, w, l, unnest(range(len(w) - l + 1)) AS i FROM d, lens WHERE len(w) >= l)),
m AS (SELECT doc_id, i, l, item_id FROM dw JOIN win USING (g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
