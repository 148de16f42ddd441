"""Fill-in-middle transformation with succinct rank and select over boundary bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import prepare

#: What marks the parts in an output. A text that holds one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Bits that one entry of a popcount directory stands for: eight words of 64.
BLOCK_BITS = 512
#: Characters of output that a task gathers before it hands them on.
FLUSH_CHARS = 4_000_000


class BitVector:
    """Packed bits with the number of ones before each block of BLOCK_BITS."""

    def __init__(self, marks: np.ndarray) -> None:
        packed = np.zeros(-(-len(marks) // BLOCK_BITS) * (BLOCK_BITS // 8), np.uint8)
        packed[: -(-len(marks) // 8)] = np.packbits(marks, bitorder="little")
        self.words = packed.view("<u8")
        self.counts = np.bitwise_count(self.words)
        self.directory = np.concatenate([[0], self.counts.reshape(-1, BLOCK_BITS // 64).sum(axis=1, dtype=np.int64).cumsum()])

    @property
    def total(self) -> int:
        return int(self.directory[-1])

    def rank(self, at: int) -> int:
        """Ones among the first ``at`` bits."""
        word, bit = divmod(at, 64)
        block = word // (BLOCK_BITS // 64)
        inside = int(self.counts[block * (BLOCK_BITS // 64) : word].sum())
        last = int(np.bitwise_count(self.words[word] & np.uint64((1 << bit) - 1))) if bit else 0
        return int(self.directory[block]) + inside + last

    def select(self, rank: int) -> int:
        """The place of the one of this rank, counted from 1."""
        block = int(self.directory.searchsorted(rank)) - 1
        left = rank - int(self.directory[block])
        word = block * (BLOCK_BITS // 64)
        while left > self.counts[word]:
            left -= int(self.counts[word])
            word += 1
        bits = int(self.words[word])
        for _ in range(left - 1):
            bits &= bits - 1
        return 64 * word + (bits & -bits).bit_length() - 1


def line_ends(raw: np.ndarray) -> np.ndarray:
    """True at the last byte of each line; what follows the last line feed is a line too."""
    ends = raw == 0x0A
    ends[-1] = True
    return ends


def char_ends(raw: np.ndarray) -> np.ndarray:
    """True at the last byte of each code point."""
    return np.append(char_starts(raw)[1:], True)


def char_starts(raw: np.ndarray) -> np.ndarray:
    return (raw & 0xC0) != 0x80


UNITS = {"line": line_ends, "char": char_ends}


def transformed(text: str, draws: tuple[int, int, int, int], unit: str = "line", rate: int = 100, spm: int = 50) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of a text: the total of its boundary bits is n, selecting two ranks
    gives the byte cuts, and the rank of a cut among the starts of code points its place in characters."""
    if not text:
        return 0, "plain", None, None, ""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    ends = BitVector(UNITS[unit](data))
    n = ends.total
    if any(m in text for m in MARKS) or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, last = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = (ends.select(k) + 1 if k else 0 for k in (first, last))
    chars = BitVector(char_starts(data))
    at, upto = chars.rank(a), chars.rank(b)
    prefix, middle, suffix = text[:at], text[at:upto], text[upto:]
    if draws[3] % 100 < spm:
        return n, "spm", at, upto - at, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", at, upto - at, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 7, unit: str = "line", rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text rearranged for fill-in-middle training: doc_id, n, form, prefix_chars, middle_chars, output.

    ``unit`` is line (ending with its line feed) or char. The draws are the first four 32-bit groups of the SHA-256 of
    ``seed:doc_id``, so they depend on the id alone and reruns agree; rows that share an id are cut by the same draws.
    ``rate`` percent of the texts are transformed, ``spm`` percent of these with the suffix first. A null or empty text
    is plain, empty and has no units; a text that holds one of MARKS is plain. A null id is hashed as no digits. Only
    doc_id and text are read, so further columns of any name do no harm. An empty table gives no rows. Nothing is
    shuffled; a task holds one batch of texts, and a text's bits take a quarter of its bytes.
    """
    prepare(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *draws)
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=columns).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, chars = [], 0
            for doc, text, *h in pdf.itertuples(index=False, name=None):
                out.append((doc, *transformed(text, h, unit, rate, spm)))
                chars += len(out[-1][-1])
                if chars > FLUSH_CHARS:
                    yield frame(out)
                    out, chars = [], 0
            yield frame(out)

    return rows.mapInPandas(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No part holds a mark, so the first of each is the one that was put in."""
    after = lambda s, mark: F.substr(s, F.locate(mark, s) + F.lit(len(mark)))
    before = lambda s, mark: F.substr(s, F.lit(1), F.locate(mark, s) - F.lit(1))

    def parts(first: str, second: str) -> list[Column]:
        rest = after(output, first)
        return [before(rest, second), before(after(rest, second), MIDDLE), after(after(rest, second), MIDDLE)]

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_, prefix_, middle_ = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)
