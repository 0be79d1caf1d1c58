"""Token ids in Parquet files: list columns, chosen encodings, bounded row groups, page indexes.

``write_tokens`` orders documents by key across files (range partitions) and within them, encodes each text
with a tokenizers file, and writes ``tokens array<int>`` with dictionary pages of bit-packed codes; the key
and counters are delta-encoded.  Row groups and pages are bounded, and every page has its minimum and
maximum in the page index, so ``read_tokens`` with a key range reads only the pages and columns it needs.

``local_start`` counts the ids before a document within its file; ``with_start`` turns it into the count of
all ids before it, from one sum per file.

Null and empty texts have only the end id.  Rows with the same key keep a fixed order (by the text's
checksum and length).  Null keys come first.  Other columns are dropped, so extra columns can't clash.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohort.llm.bpe_tree import latin_pattern, list_array
from cohort.llm.common import bounded_batches

#: Distinct units, and chunks, that a Python worker remembers; beyond it the memory starts anew.
REMEMBER = 650_000
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
#: The library turns white space into token borders, so what stands between is encoded by itself.
CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")


class Units(dict):
    """Ids of the units (pre-tokens) of plain texts; the library's BPE model runs when a new one is looked up."""

    def __init__(self, model: Callable[[str], list]):
        self.model = model
        self.long: list[str] = []
        # the printable stand-in of each byte in a byte-level vocabulary: itself if visible, else the next from 256 on
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in seen]
        stand = {x: chr(x) for x in seen} | {x: chr(256 + i) for i, x in enumerate(rest)}
        self.visible = {i: "".join(stand[x] for x in chr(i).encode()) for i in range(256)}

    def __missing__(self, unit: str) -> bytes:
        ids = self[unit] = array("i", [t.id for t in self.model(unit.translate(self.visible))]).tobytes()
        if len(unit) > 64:
            self.long.append(unit)
        return ids

    def forget_long(self) -> None:
        for unit in self.long:
            del self[unit]
        self.long.clear()


class Encoder:
    """A tokenizers file with a memory of what it has encoded.

    Texts are encoded in parts that the library treats independently: what stands between white space.
    For the usual kind of file (NFC, white space to one space, lower case; split by ``SPLIT``; byte-level BPE)
    a plain text, of the first 256 characters, is cut into the library's own pre-tokens, and only the library's BPE
    model runs on each distinct one; there, normalising is lower-casing.
    """

    #: Normalizer and split that the short way stands for (the file must have just these).
    NORMAL = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: ``SPLIT`` with the commonest kind first, which cuts alike: no other kind begins with a letter.
    CUT = r"[\p{L}]+|'s|'t|'re|'ve|'m|'ll|'d|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        normal = [(n["type"], (n.get("pattern") or {}).get("Regex")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        usual = normal == self.NORMAL and [x["type"] for x in before] == ["Split", "ByteLevel"]
        usual = usual and before[0]["pattern"].get("Regex") == self.SPLIT and before[0]["invert"] and not (before[1]["add_prefix_space"] or before[1]["use_regex"])
        self.cut = latin_pattern(self.CUT) if usual else None
        self.chunks: dict[str, bytes] = {}
        self.units = Units(self.tok.model.tokenize)

    def is_plain(self, text: str) -> bool:
        if self.cut is None or any(t in text for t in self.special):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text): ``end_id`` closes each text."""
        for known in (self.chunks, self.units):
            if len(known) > REMEMBER:
                known.clear()
        plain = [bool(t) and self.is_plain(t) for t in texts]
        parts = [CHUNK.findall(t) if t and not p else [] for t, p in zip(texts, plain)]
        chunks = list({c for s in parts for c in s if c not in self.chunks})
        for e, chunk in zip(self.tok.encode_batch_fast(chunks, add_special_tokens=False), chunks):
            self.chunks[chunk] = array("i", e.ids).tobytes()
        end, chunk_ids, unit_ids = array("i", [end_id]).tobytes(), self.chunks.__getitem__, self.units.__getitem__
        rows = [b"".join(map(unit_ids, self.cut.findall(t.lower())) if p else map(chunk_ids, s)) + end for t, s, p in zip(texts, parts, plain)]
        for chunk in chunks:
            if len(chunk) > 64:
                del self.chunks[chunk]
        self.units.forget_long()
        return np.frombuffer(b"".join(rows), np.int32), np.array([len(r) // 4 for r in rows], np.int64)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Write ``key, n_tokens, part, local_start, tokens`` to Parquet files in ascending key order."""
    bounded_batches(df.sparkSession)
    src = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    tie: list[Column] = [F.crc32("text"), F.length("text")]
    src = src.repartitionByRange(F.col("key"), *tie).sortWithinPartitions(F.col("key"), *tie)
    kind = src.schema["key"].dataType.simpleString()

    def run(batches):
        start, part = 0, TaskContext.get().partitionId()
        for b in batches:
            flat, n = encoder(tokenizer).encode(b.column(1).to_pylist(), end_id)
            before = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(before),
                                              list_array(flat, n)], names=["key", "n_tokens", "part", "local_start", "tokens"])

    rows = src.mapInArrow(run, f"key {kind}, n_tokens long, part int, local_start long, tokens array<int>")
    (rows.withColumnRenamed("key", key).write
     .option("parquet.writer.version", "v2").option("parquet.block.size", ROW_GROUP_BYTES)
     .option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
     .option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#tokens.list.element", "true")
     .option("compression", "zstd").parquet(path))


def read_tokens(spark: SparkSession, path: str, low=None, high=None, key: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """Rows of a key range (both ends included); the filter and the columns reach the page index."""
    df = spark.read.parquet(path)
    if low is not None:
        df = df.where(F.col(key) >= F.lit(low))
    if high is not None:
        df = df.where(F.col(key) <= F.lit(high))
    return df.select(*columns) if columns else df


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``part`` and the ids in all files before it.  Reads two narrow columns."""
    sums = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))


def with_start(spark: SparkSession, path: str) -> DataFrame:
    """All rows with ``start``: the ids of all documents before the row, in file order."""
    rows = spark.read.parquet(path)
    starts = F.broadcast(file_starts(spark, path))  # one row of two numbers per written file
    return rows.join(starts, "part").withColumn("start", F.col("file_start") + F.col("local_start"))
