"""Bounded-space online packing of tokenized documents into training windows."""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import prepare, stored

WINDOW = 1024
#: Open windows per partition.
OPEN = 64
#: Partitions whose leftover windows one task merges: OPEN times as many windows at most.
MERGED_PARTITIONS = 32
#: The id that ends every document.
END = 0

_encoders: dict[str, object] = {}


def byte_table() -> dict[str, int]:
    """Byte-level BPE files write bytes as printable characters: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """The vocabulary of a byte-level BPE file, as an encoder that gives the same ids as the file's own library, faster.

    The ids of such a file are its merge ranks. Strings of special tokens in a text are ordinary text.
    """
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        table, special = byte_table(), {x["content"] for x in whole["added_tokens"]}
        ranks = {bytes(table[c] for c in word): i for word, i in whole["model"]["vocab"].items() if word not in special}
        _encoders[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


class OpenWindows:
    """A fixed number of open windows; takes pieces one by one and gives back windows as they close."""

    def __init__(self, window: int, most: int) -> None:
        self.window, self.most, self.made = window, most, 0
        self.free: list[tuple[int, int]] = []  # (room, window number), sorted
        self.held: dict[int, list] = {}

    def place(self, length: int, item: object) -> Iterator[tuple[int, int, list]]:
        """Best fit; if none fits and all are open, the fullest closes. Yields (number, used, [(offset, item)])."""
        at = bisect.bisect_left(self.free, (length, -1))
        if at < len(self.free):
            room, number = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                yield self.close(self.free.pop(0))
            room, number = self.window, self.made
            self.made += 1
            self.held[number] = []
        self.held[number].append((self.window - room, item))
        if room == length:
            yield self.close((0, number))
        else:
            bisect.insort(self.free, (room - length, number))

    def close(self, window: tuple[int, int]) -> tuple[int, int, list]:
        return window[1], self.window - window[0], self.held.pop(window[1])

    def rest(self) -> Iterator[tuple[int, int, list]]:
        while self.free:
            yield self.close(self.free.pop())


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, open_windows: int = OPEN) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    A document is its token ids and then END. Full windows are cut off it; the rest is one piece, placed best-fit into one
    of the partition's open windows; if none fits the fullest is emitted. What is still open when a partition ends is
    merged with the leftovers of neighbouring partitions, best fit first by size. Returns a row per piece: doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are END alone. Repeated rows are packed one by one. An empty table gives no rows. A partition
    holds ``open_windows`` windows of numbers, never ids or texts; the pieces are written once, so a retried task cannot
    mix two packings, and only leftover windows (at most ``open_windows`` per partition) are moved afterwards.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "used", "leftover"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode_to_numpy
        part = TaskContext.get().partitionId() << 32
        open_ = OpenWindows(window, open_windows)
        out: list[tuple] = []
        emit = lambda closed, left: out.extend((*item, part + closed[0], offset, closed[1], left) for offset, item in closed[2])
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.append(encode(text or "", disallowed_special=()), END).astype("<u4") if text else np.array([END], "<u4")
                raw, total = ids.tobytes(), len(ids)
                for start in range(0, total, window):
                    length = min(window, total - start)
                    for closed in open_.place(length, (doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), total)):
                        emit(closed, False)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=columns)
                out.clear()
        for closed in open_.rest():
            emit(closed, True)
        yield pd.DataFrame(out, columns=columns)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, used long, leftover boolean"
    pieces = stored(rows.mapInPandas(place, schema), "pieces")
    left = pieces.where("leftover").groupBy("sequence_id").agg(F.max("used").alias("used"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["used", "sequence_id"], ascending=[False, True])
        open_, out = OpenWindows(window, len(pdf)), []
        closed = [c for n, s in zip(pdf["used"], pdf["sequence_id"], strict=True) for c in open_.place(int(n), int(s))]
        for _, _, items in [*closed, *open_.rest()]:
            out += [(s, items[0][1], offset) for offset, s in items]
        return pd.DataFrame(out, columns=["sequence_id", "merged_id", "base"])

    group = F.floor(F.col("sequence_id") / F.lit(MERGED_PARTITIONS * 2.0**32)).alias("g")
    merged = left.groupBy(group).applyInPandas(merge, "sequence_id long, merged_id long, base long")
    moved = pieces.where("leftover").join(merged, "sequence_id").withColumn("sequence_id", F.col("merged_id")).withColumn("offset", F.col("offset") + F.col("base"))
    names = columns[:7]
    return pieces.where("NOT leftover").select(*names).unionByName(moved.select(*names))
