"""Operator 13: ranked lexical search by NRA, sequential reads of impact-sorted lists alone.

The index has a row per term asked for and document: the posting's impact, and the level of the term's list it stands
in. Level 0 holds the highest impacts, and each further level about as many as all before it. The table is bucketed
by document and sorted by level within a bucket, so a document's sums meet without a shuffle, and a round reads the
front of the lists. A directory keeps the highest impact of every level.

A round sums, for each item, the impacts of the levels it has read: a document's lower bound. With the most that the
unread levels of the terms not seen in it can add, it has an upper bound. An item is open while a document not seen
at all could still reach the tenth lower bound. After that, only documents whose upper bound reaches it are read on,
until the lists end and all bounds are scores; documents that tie with the tenth stay in to the end.
"""

from __future__ import annotations

import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltbed.llm.common import ascii_lower, shared_folder, stored, table

#: Fixed value of the contract, for texts whose A-Z may still be upper-case.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fixed values of the contract: the scale of weights and saturations, and how a document's length counts.
WEIGHT = "cast(floor(1000 * ln((2 * {n} + 2D) / (2 * df + 1D))) as bigint)"
SATURATION = "(1000000000 * tf) div (1000 * tf + 8 * (10 + (90 * n * {n}) div {l}))"
#: About so many postings are a term's level 0.
FIRST = 128
#: Saturations, below a million, are told apart by so much when lists are cut into levels.
STEP = 1000
#: A round reads on by so many levels. With fewer documents left than FEW for an item, the rest is read at once.
LEVELS, FEW = 2, 1000
#: At most so many terms, or terms of items, are sent to every worker; more are joined by a shuffle.
MOST = 200_000

#: Bytes as words are told apart: A-Z lower-cased, blanks for all that is no part of a word.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _postings(docs: DataFrame, known: list[tuple[str, int]] | None) -> DataFrame:
    """A row per document with a word, without a term, and one for each of its terms: row, doc_id, h, term or t, tf, n.

    known has the terms asked for and their numbers; where it is None, every term is returned as itself.
    """
    spread = None if known is None else docs.sparkSession.sparkContext.broadcast(known)
    of, kind = ("term", pa.string()) if known is None else ("t", pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = None if spread is None else {term.encode(): t for term, t in spread.value}
        for batch in batches:
            at, rows, found = array("q"), [], []
            tf, n = array("q"), array("q")
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = (text or b"").translate(_FOLD).split()
                if not words:
                    continue
                if numbers is None:
                    seen = Counter(words)
                    found += [None, *[w.decode() for w in seen]]
                else:
                    seen = Counter(filter(numbers.__contains__, words))
                    found += [None, *map(numbers.__getitem__, seen)]
                at.extend([i] * (len(seen) + 1))
                rows += [i, *[None] * len(seen)]
                tf.extend([0, *seen.values()])
                n.extend([len(words)] * (len(seen) + 1))
            once = pa.array(rows, pa.int64())
            at, tf, n = (pa.array(np.asarray(x)) for x in (at, tf, n))
            columns = [batch.column("row").take(at), batch.column("doc_id").take(once), batch.column("h").take(once), pa.array(found, kind), tf, n]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "h", of, "tf", "n"])

    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("h"), "text")
    return d.mapInArrow(run, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, {of} {'string' if known is None else 'long'}, tf long, n long")


def _small(df: DataFrame, most: int) -> DataFrame:
    """df, to be sent to every worker if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class _Index:
    """Impact-sorted lists of the terms (term, t) over docs (doc_id, text), and their directory."""

    def __init__(self, docs: DataFrame, terms: DataFrame, most: int) -> None:
        self.spark = docs.sparkSession
        known = [tuple(r) for r in terms.select("term", "t").limit(most + 1).collect()]
        few = len(known) <= most
        found = _postings(docs, known if few else None)
        if not few:
            found = found.join(terms, "term", "left").where("t IS NOT NULL OR term IS NULL")
        found = stored(found.select("row", "doc_id", "h", "t", "tf", "n"))
        self.docs = found.where("t IS NULL").select("row", "doc_id", "h")
        size = found.where("t IS NULL").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
        n, length = int(size[0]), int(size[1])

        found = found.where("t IS NOT NULL").select("row", "t", F.expr(SATURATION.format(n=f"{n}L", l=f"{length}L")).alias("s"))
        parts = found.groupBy("t", F.expr(f"s div {STEP}").alias("part")).agg(F.count("*").alias("k"), F.max("s").alias("best"))
        above = F.sum("k").over(Window.partitionBy("t").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1))
        above = F.coalesce(above, F.lit(0))
        level = F.when(above < FIRST, F.lit(0)).otherwise(F.floor(F.log2(above / FIRST)) + 1).cast("int")
        lists = parts.withColumn("level", level).groupBy("t", "level").agg(F.min("part").alias("low"), F.max("best").alias("best"), F.sum("k").alias("k"))
        whole = Window.partitionBy("t")
        lists = lists.withColumn("df", F.sum("k").over(whole)).withColumn("w", F.expr(WEIGHT.format(n=n))).where("w > 0")
        self.lists = stored(lists.select("t", "level", "low", "w", (F.col("best") * F.col("w")).alias("best")))
        self.last = self.lists.agg(F.max("level")).first()[0]

        cuts = self.lists.groupBy("t", "w").agg(F.sort_array(F.collect_list(F.struct("level", "low"))).alias("cuts"))
        cuts = F.broadcast(cuts) if few else cuts
        at = F.get("cuts", F.size(F.filter("cuts", lambda c: c["low"] > F.expr(f"s div {STEP}"))))["level"]
        found = found.join(cuts, "t").select("row", "t", at.alias("level"), (F.col("w") * F.col("s")).alias("impact"))
        # a bucketed table, so that sums by item and row need no shuffle
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"siltbed_index_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark).rstrip('/')}/{self.name}"
        found.repartition(parts, "row").write.bucketBy(parts, "row").sortBy("level", "t").option("path", path).saveAsTable(self.name)

    def read(self, most: int) -> DataFrame:
        """row, t, level and impact of the lists' levels up to `most`."""
        return self.spark.table(self.name).where(F.col("level") <= most)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _bounded(rows: DataFrame) -> DataFrame:
    """item, row, lower and upper from the impacts read; rest is the item's bound of all terms, bound the term's own."""
    sums = rows.groupBy("item", "row").agg(F.sum("impact").alias("lower"), F.sum("bound").alias("own"), F.first("rest").alias("rest"))
    return sums.select("item", "row", "lower", (F.col("lower") + F.col("rest") - F.col("own")).alias("upper"))


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents with a score above 0, equal ones by doc_id.

    items has item_id and text. Rows that share an item_id are one item with the terms of all; a null item_id is an
    item too. Each row of docs is a document, also where ids repeat: equal scores and ids come in the order of a hash
    of the text. A null id comes after all others. Null and empty texts have no terms and count for nothing; an item
    without a term that a document holds, an empty docs or an empty items give no rows. Other columns are dropped.
    What the driver gets are the items' terms, at most `most` of them, and counts; the result is a stored table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.struct("item_id").alias("key"), F.explode(F.split(ascii_lower(F.col("text")), NOT_WORD)).alias("term")).where("term <> ''").distinct()
    asked = stored(asked)
    keys = stored(asked.select("key").distinct().withColumn("item", F.monotonically_increasing_id()))
    terms = stored(asked.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    wanted = stored(asked.join(keys, "key").join(terms, "term").select("item", "t"))
    index = _Index(docs, terms, most)
    best = Window.partitionBy("item").orderBy(F.desc("lower"))
    todo = wanted.select("item").distinct().select("item", F.lit(LEVELS).alias("upto"), F.lit(False).alias("closed"))
    left, done = None, None
    while index.last is not None:
        todo = stored(todo.withColumn("upto", F.least("upto", F.lit(index.last))))
        upto = todo.agg(F.max("upto")).first()[0]
        if upto is None:
            break
        # what unread levels can add, by term and by item
        unread = F.coalesce(F.max(F.when(F.col("level") > F.col("upto"), F.col("best"))), F.lit(0))
        terms_of = todo.join(wanted, "item").join(index.lists, "t").groupBy("item", "t", "upto", "closed").agg(unread.alias("bound"))
        terms_of = stored(terms_of.withColumn("rest", F.sum("bound").over(Window.partitionBy("item"))))
        rest = terms_of.select("item", "rest").distinct()
        small = _small(terms_of.where("NOT closed").drop("closed"), most)
        state = _bounded(index.read(upto).join(small, "t").where("level <= upto"))
        if left is not None:
            of_left = _small(terms_of.where("closed").drop("closed"), most)
            rows = index.read(upto).join(left.hint("shuffle_hash"), "row").join(of_left, ["item", "t"]).where("level <= upto")
            state = state.unionByName(_bounded(rows))
        tenth = state.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).groupBy("item").agg(F.count("*").alias("found"), F.min("lower").alias("lower"))
        tenth = tenth.select("item", F.when(F.col("found") >= k, F.col("lower")).otherwise(0).alias("tenth"))
        tenth = stored(todo.join(tenth, "item", "left").join(rest, "item", "left").select("item", "upto", F.coalesce("rest", F.lit(0)).alias("rest"), F.coalesce("tenth", F.lit(0)).alias("tenth")))
        over = F.col("upto") >= index.last
        shut = _small(tenth.where(over | (F.col("rest") < F.col("tenth"))).select("item", "tenth", over.alias("over")), most)
        left = stored(state.join(shut, "item").where("upper >= tenth").select("item", "row", "lower", "over"))
        scored = left.where("over").select("item", "row", F.col("lower").alias("score"))
        done = scored if done is None else done.unionByName(scored)
        left = left.where("NOT over").select("item", "row")
        held = left.groupBy("item").agg(F.count("*").alias("held"))
        further = F.when(F.col("held") <= FEW, F.lit(index.last)).otherwise(F.col("upto") + LEVELS)
        todo = tenth.where(~over).join(held, "item", "left").select("item", further.alias("upto"), F.col("held").isNotNull().alias("closed"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    of_item = items.schema["item_id"].dataType.simpleString()
    if done is None:
        index.drop()
        return spark.createDataFrame([], f"item_id {of_item}, rank int, doc_id {kind}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "h", "row")
    ranked = done.where("score > 0").join(index.docs, "row").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = stored(ranked.join(keys, "item").select("key.item_id", "rank", "doc_id", "score"))
    index.drop()
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)
OP13_SQL = f"""
WITH d AS (SELECT * FROM (SELECT doc_id, {_TERMS} AS w FROM documents) WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms)))))::BIGINT AS score FROM q JOIN p USING (term) JOIN f USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
