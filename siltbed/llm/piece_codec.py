"""Operator 11: SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece has a whitespace marker behind another character, no merge crosses the place before a marked word, so
a text falls into chunks, markers and what follows them, that are segmented apart. Words repeat, so each worker keeps
a table of the chunks it has met, segments each new one once, and joins the ids back by position. The table is no
shuffled one: its rows would be the corpus's vocabulary, which grows without bound, joined to every position of every
text, while a worker's own table gives the same ids in a map over the rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as compute
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm.common import table

MODEL = "piece_bpe_32k.model"
#: The character that stands for a blank in pieces.
MARK = "▁"
#: A worker's table has at most so many chunks, or those of one part of a batch; a full one starts anew, and chunks of
#: more characters are not kept, which changes no result.
CACHED, SHORT = 400_000, 40
#: About so many bytes are encoded, or ids decoded, before rows are handed on.
BYTES, IDS = 3_000_000, 2_000_000

_chunks = re.compile(" +[^ ]*").findall


class Chunks:
    """A table of chunks, blanks and what follows them, with their ids as four bytes each."""

    def __init__(self, model: bytes) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a whitespace marker")
        self.mark, self.end = (array("i", [i]).tobytes() for i in (self.library.piece_to_id(MARK), self.library.eos_id()))
        self.known: dict[str, bytes] = {}

    def _learn(self, found: set[str]) -> set[str]:
        """Adds the ids of the chunks that are new, and tells which those are."""
        new = found.difference(self.known)
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
            new = found
        # the library puts a blank before what it is given; it takes an empty text for no text
        plain = [c for c in new if c != " "]
        ids = self.library.encode([c[1:] for c in plain], num_threads=1)
        self.known.update(zip(plain, (array("i", x).tobytes() for x in ids), strict=True))
        self.known[" "] = self.mark
        return new

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text and the end id."""
        found = [_chunks(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        new = self._learn(set().union(*found))
        of = self.known.__getitem__
        yield from (b"".join(map(of, chunks)) + self.end for chunks in found)
        for c in new:
            if len(c) > SHORT:
                self.known.pop(c, None)


_built: dict[bytes, Chunks] = {}


def _table(model: bytes) -> Chunks:
    """The model's table, kept in a worker; another model takes its place."""
    if model not in _built:
        _built.clear()
        _built[model] = Chunks(model)
    return _built[model]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _parts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about most."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, the library's ids of the whole text and the end id, a row per input row.

    A null or empty text has the end id alone. A text's own marker characters are blanks, as they are to the library.
    Repeated rows and null doc_ids stay; other columns are dropped; an empty table gives an empty table. The model,
    which does not grow with the texts, is sent to the workers. Its pieces must not cross markers, or this fails.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _table(spread.value)
        for batch in batches:
            texts = batch.column(1)
            for a, b in _parts(compute.binary_length(texts).fill_null(0).to_pylist(), BYTES):
                found = list(known.ids(texts[a:b].to_pylist()))
                ends = array("i", accumulate((len(x) // 4 for x in found), initial=0))
                flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(found))])
                ids = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], ids], ["doc_id", "ids"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids", keep_ids: bool = False) -> DataFrame:
    """doc_id and text, what the library's decode(ids) gives, and ids if keep_ids, a row per input row.

    Null or empty ids give an empty text. Null ids within a list are left out; ids that the model has not fail.
    """
    spread = encoded.sparkSession.sparkContext.broadcast(model)
    d = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _table(spread.value).library
        for batch in batches:
            lists = batch.column(1)
            for a, b in _parts(lists.value_lengths().fill_null(0).to_pylist(), IDS):
                part = lists[a:b]
                texts = [library.decode([i for i in x if i is not None]) if x else "" for x in part.to_pylist()]
                more = [part] if keep_ids else []
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(texts, pa.string()), *more], ["doc_id", "text", *["ids"] * keep_ids])

    return d.mapInArrow(run, f"doc_id {kind}, text string" + ", ids array<int>" * keep_ids)


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = read_model(public_tokenizers.path(MODEL))
    both = decode(encode(table(spark, sf_dir, "documents"), model), model, keep_ids=True)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join("ids", " ")).alias("ids_sha256"), digest(F.col("text")).alias("decoded_sha256"))
