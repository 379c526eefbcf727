"""Packing: concatenate and cut.

All documents form one stream of token ids. Two passes: the first tokenizes, stores the ids and the
running total inside each partition; the totals of the partitions give global offsets by a prefix
sum; the second pass cuts the stream into fixed windows. A document that crosses a window's end has
one boundary record per window it touches, so no id is dropped and only the very last window can be
short.

The order of the stream is that of the partitions of the first pass and of the rows in them. It is
read from the stored ids, so a lost executor cannot change it.

Defined results: a null or empty text is the end id alone; rows with equal ids or texts are packed
each on its own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from reelmill.llm.batches import arrow_rows, text_slices, texts
from reelmill.session import store

WINDOW = 2048
END_ID = 1
#: Chunks whose ids a task remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
#: Texts with none of these are cut at the edges of words before their ids are looked up: their letters
#: are those of ``LETTERS``, nothing composes or contracts, and no special token is written out.
UNPLAIN = re.compile("['\u00aa\u00b5\u00ba\u0100-\U0010ffff]|<\\|")
LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
PLAIN = re.compile(f"[{LETTERS}]+|[^{LETTERS} \n]+")
WORD = re.compile(f"[{LETTERS}]+")


class ChunkTokenizer(dict):
    """Ids of texts, by the tokenizers library, one call per new chunk.

    For tokenizers that put texts in lower case, drop white space and part letters from other
    characters. Chunks lie between blanks; plain texts are cut further, into words and what is
    between them. A word goes to the tokenizer's model, any other chunk through all its steps.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model.tokenize
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.letters = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(128, 256)}

    def __missing__(self, chunk: str) -> bytes:
        if WORD.fullmatch(chunk):
            word = chunk if chunk.isascii() else chunk.translate(self.letters)
            ids = [t.id for t in self.model(word)]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        self[chunk] = found = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if len(self) > REMEMBERED:
            self.clear()
        if UNPLAIN.search(text) is None:
            return b"".join(map(self.__getitem__, PLAIN.findall(text.lower())))
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def token_stream(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Stored ids of every document with its place in its partition: doc_id, ids, doc_tokens, part, before."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    end = np.asarray([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType
    schema = StructType([
        StructField("doc_id", kind), StructField("ids", BinaryType()), StructField("doc_tokens", LongType()),
        StructField("part", IntegerType()), StructField("before", LongType()),
    ])

    def encode(batches):
        tokenizer = ChunkTokenizer(shared.value)
        part, total = TaskContext.get().partitionId(), 0
        for rows in text_slices(batches):
            ids = [tokenizer.encode(t) + end for t in texts(rows.column("text"))]
            n = np.asarray([len(x) // 4 for x in ids], np.int64)
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n), pa.array([part] * len(ids), pa.int32()), pa.array(before)],
                names=schema.names,
            )

    with arrow_rows(spark, 2000):
        return store(docs.select("doc_id", "text").mapInArrow(encode, schema), "tokens")


def global_offsets(stream: DataFrame) -> DataFrame:
    """part and the ids before it in the whole stream. One row per partition of the first pass."""
    totals = stream.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("base"))


def cut_windows(stream: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per piece: a document's ids that lie in one window, with the ids themselves.

    The offsets are broadcast: 12 bytes for each task of the first pass.
    """
    placed = stream.join(F.broadcast(global_offsets(stream)), "part").withColumn("at", F.col("base") + F.col("before"))
    last = F.expr(f"(at + doc_tokens - 1) div {window}")
    pieces = placed.withColumn("sequence_id", F.explode(F.sequence(F.expr(f"at div {window}"), last)))
    begin = F.col("sequence_id") * window
    pieces = pieces.withColumn("start", F.greatest(F.lit(0).cast("long"), begin - F.col("at")))
    pieces = pieces.withColumn("length", F.least(F.col("doc_tokens"), begin + window - F.col("at")) - F.col("start"))
    return pieces.select(
        "doc_id", "start", "length", "doc_tokens", "sequence_id", (F.col("at") + F.col("start") - begin).alias("offset"),
        (F.col("start") + F.col("length") < F.col("doc_tokens")).alias("continues"),
        F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))").alias("ids"),
    )


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their ids as little-endian unsigned 32-bit numbers."""
    return cut_windows(token_stream(docs, tokenizer_path, end_id), window)
