"""Operator 3: greedy word-piece counts by a linear longest-match automaton.

A trie of all pieces has, at each node, a failure link and the number of pieces that are popped on the way there, so
a word's greedy longest-match count takes one step per byte and builds no piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Counts of so many short words are kept in a worker; a full cache starts anew, which changes no result.
CACHED, SHORT = 300_000, 48


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a rank file; those that begin a word begin with a blank."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton(dict):
    """Maps a word without blanks to its number of pieces, or to -1 if the pieces cannot spell it."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.go: dict[int, int] = {}  # node * 256 + byte to node; 0 is the root
        end, count = set(), 0
        for piece in filter(None, pieces):
            node = 0
            for c in piece:
                nxt = self.go.get(node << 8 | c)
                if nxt is None:
                    count += 1
                    nxt = self.go[node << 8 | c] = count
                node = nxt
            end.add(node)
        self.fail, self.pops = [-1] * (count + 1), [0] * (count + 1)
        children: list[list[tuple[int, int]]] = [[] for _ in range(count + 1)]
        for k, v in self.go.items():
            children[k >> 8].append((k & 255, v))
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for c, v in children[u]:
                todo.append(v)
                if v in end:
                    self.fail[v], self.pops[v] = 0, 1
                    continue
                z, n = self.fail[u], self.pops[u]
                while z >= 0 and (z << 8 | c) not in self.go:
                    n += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.go[z << 8 | c], n

    def count(self, word: bytes) -> int:
        go, fail, pops = self.go, self.fail, self.pops
        node = n = 0
        for c in b" " + word:
            nxt = go.get(node << 8 | c)
            while nxt is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return -1
                nxt = go.get(node << 8 | c)
            node = nxt
        while node > 0:
            n += pops[node]
            node = fail[node]
        return n if node == 0 else -1

    def __missing__(self, word: bytes) -> int:
        n = self.count(word)
        if len(word) <= SHORT:
            if len(self) >= CACHED:
                self.clear()
            self[word] = n
        return n


_built: dict[bytes, Automaton] = {}


def _automaton(pieces: list[bytes]) -> Automaton:
    """The pieces' automaton, built once in a worker; another vocabulary takes its place."""
    key = hashlib.sha256(b"".join(len(p).to_bytes(8, "little") + p for p in pieces)).digest()
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(pieces)
    return _built[key]


def piece_counts(docs: DataFrame, pieces: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_pieces and n_unknown, a row per input row.

    Words stand between ASCII blanks. A word that the pieces cannot spell counts as one piece and as unknown. Null and
    empty texts have no words. Repeated rows and null ids stay; other columns are dropped; an empty table gives an
    empty table. What goes to the workers is the vocabulary, which does not grow with the texts.
    """
    spread = docs.sparkSession.sparkContext.broadcast(pieces)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(spread.value)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = [automaton[w] for w in (text or "").encode("utf-8", "surrogatepass").split()]
                unknown = found.count(-1)
                rows.append((len(found), sum(found) + 2 * unknown, unknown))
            out = pd.DataFrame(rows, columns=["n_words", "n_pieces", "n_unknown"], dtype="int64")
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInPandas(counts, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words long, n_pieces long, n_unknown long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts(table(spark, sf_dir, "documents"), read_pieces(VOCABULARY))


# distinct words, as hex digits, each cut by its longest piece again and again
OP3_SQL = rf"""WITH RECURSIVE v AS (SELECT hex(from_base64(piece)) AS p FROM read_csv('{VOCABULARY}', delim=' ', header=false, quote='', escape='', columns={{'piece': 'VARCHAR', 'rank': 'BIGINT'}})),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
o AS (SELECT r, unnest(w) AS word FROM d),
g AS (SELECT word, 0 AS n, '20' || hex(encode(word)) AS rest FROM (SELECT DISTINCT word FROM o) UNION ALL
SELECT word, n + 1, substr(rest, length(p) + 1) FROM (SELECT word, n, rest, p FROM (SELECT word, n, rest, unnest(range(1, least(length(rest) // 2, (SELECT max(length(p)) // 2 FROM v)) + 1)) AS l FROM g WHERE rest <> '') t
JOIN v ON v.p = left(rest, 2 * l) QUALIFY row_number() OVER (PARTITION BY word ORDER BY l DESC) = 1)),
k AS (SELECT word, n FROM g WHERE rest = ''),
s AS (SELECT r, count(*) AS n_words, sum(coalesce(n, 1)) AS n_pieces, count(*) FILTER (WHERE n IS NULL) AS n_unknown FROM o LEFT JOIN k USING (word) GROUP BY r)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_pieces, 0)::BIGINT AS n_pieces, coalesce(n_unknown, 0)::BIGINT AS n_unknown FROM d LEFT JOIN s USING (r)"""
