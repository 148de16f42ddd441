"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked id pairs in packed sorted arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.common import discard, prepare, remove_folder, shared_dir, stored
from reviewloom.llm.packing import encoder

#: Links of a group that are listed one by one; beyond it equal ids are counted first.
LISTED_LINKS = 4096
#: Distinct keys that a task adds up before it hands its counts on.
HELD_KEYS = 4_000_000
#: Tokens whose groups a task gathers before it hands them on.
FLUSH_TOKENS = 500_000
#: A packed key holds the first tokenizer's id above these bits and the second's below.
ID_BITS = 32


class Aligner:
    """Both vocabularies of a worker: sizes of ids, and each id as text with what follows it in a list of groups."""

    def __init__(self, byte_tokenizer: str, piece_tokenizer: str) -> None:
        import sentencepiece

        self.a, self.b = encoder(byte_tokenizer), sentencepiece.SentencePieceProcessor(model_file=piece_tokenizer)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.vocab_size()) for p in [self.b.id_to_piece(i)]]
        self.size_a, self.size_b = np.array([self._size(i) for i in range(self.a.n_vocab)]), np.array(list(map(len, self.bytes_b)))
        self.shown = [f"{i}{end}" for i in range(len(self.size_a)) for end in ",|"] + [f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"]

    def _size(self, i: int) -> int:
        """Bytes of an id, 0 of one that no token has."""
        try:
            return len(self.a.decode_single_token_bytes(i))
        except KeyError:
            return 0

    def align(self, text: str | None) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links, groups, keys, links): keys are the distinct linked pairs, sorted."""
        nothing = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        if not text:
            return nothing
        raw = f" {text}".encode()
        a, b = self.a.encode_to_numpy(f" {text}", disallowed_special=()).astype(np.int64), self.b.encode(text)
        ends_a = self.size_a[a].cumsum()
        # A byte-level tokenizer's tokens are slices of the text, so their sizes tell whether they are all of it.
        if b"".join(map(self.bytes_b.__getitem__, b)) != raw or ends_a[-1] != len(raw):
            return nothing
        b = np.array(b, np.int64)
        ends_b = self.size_b[b].cumsum()
        ends = np.zeros(len(raw) + 1, bool)
        ends[ends_b] = True
        common = ends_a[ends[ends_a]]
        of_a, of_b = common.searchsorted(ends_a), common.searchsorted(ends_b)
        n_a, n_b = np.bincount(of_a, minlength=len(common)), np.bincount(of_b, minlength=len(common))
        upto_a, upto_b = n_a.cumsum(), n_b.cumsum()
        shown = np.empty(len(a) + len(b), np.int64)
        at_a, at_b = np.arange(len(a)), np.arange(len(b))
        shown[at_a + (upto_b - n_b)[of_a]] = 2 * a + (at_a + 1 == upto_a[of_a])
        shown[at_b + upto_a[of_b]] = 2 * (len(self.size_a) + b) + (at_b + 1 == upto_b[of_b])
        keys, links = linked(a, b, of_a, n_a, n_b, upto_a, upto_b)
        return len(a), len(b), len(common), int((n_a * n_b).sum()), "".join(map(self.shown.__getitem__, shown.tolist()))[:-1], keys, links


def linked(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the linked pairs and how often each is linked. A large group is never listed link by link."""
    large = n_a * n_b > LISTED_LINKS
    places = np.flatnonzero(~large[of_a])
    times = n_b[of_a[places]]
    inside = np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
    first, first_b = np.repeat(places, times), (upto_b - n_b)[of_a]
    parts = [np.unique((a[first] << ID_BITS) | b[first_b[first] + inside], return_counts=True)]
    for g in np.flatnonzero(large):
        x, nx = np.unique(a[upto_a[g] - n_a[g] : upto_a[g]], return_counts=True)
        y, ny = np.unique(b[upto_b[g] - n_b[g] : upto_b[g]], return_counts=True)
        parts.append((((x[:, None] << ID_BITS) | y).ravel(), (nx[:, None] * ny).ravel()))
    return parts[0] if len(parts) == 1 else summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = keys.argsort(kind="stable")
    keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], np.add.reduceat(counts, begins) if len(keys) else counts


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_tokenizer: str, piece_tokenizer: str) -> Aligner:
    if (byte_tokenizer, piece_tokenizer) not in _aligners:
        _aligners[byte_tokenizer, piece_tokenizer] = Aligner(byte_tokenizer, piece_tokenizer)
    return _aligners[byte_tokenizer, piece_tokenizer]


def alignments(docs: DataFrame, byte_tokenizer: str, piece_tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Align the tokens of a byte-level BPE (A, of a space and the text) and a sentencepiece model (B, which adds it).

    Returns doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``: ids between byte offsets where tokens of
    both end), keys (distinct linked id pairs, A's id above ID_BITS bits, sorted) and links (how often each is linked in
    the document). Null and empty texts, and texts that either tokenizer changes, have zeros, an empty string and empty
    arrays. Special tokens' strings are plain text. Repeated rows are documents of their own. Long texts are taken whole;
    in a large group equal ids are counted before pairs are made. Only doc_id and text are read. Nothing is shuffled.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "keys", "links"]

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = aligner(byte_tokenizer, piece_tokenizer)
        for pdf in batches:
            out, tokens = [], 0
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                out.append((doc, *own.align(text)))
                tokens += out[-1][1] + out[-1][2]
                if tokens > FLUSH_TOKENS:
                    yield pd.DataFrame(out, columns=columns)
                    out, tokens = [], 0
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(align, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string, keys array<long>, links array<long>")


def partial_counts(aligned: DataFrame) -> DataFrame:
    """(key, n): documents that hold each linked pair, as far as a task has met them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for pdf in batches:
            here, n = np.unique(np.concatenate([np.zeros(0, np.int64), *pdf["keys"]]), return_counts=True)
            keys, counts = summed(np.concatenate([keys, here]), np.concatenate([counts, n]))
            if len(keys) > HELD_KEYS:
                yield pd.DataFrame({"key": keys, "n": counts})
                keys, counts = keys[:0], counts[:0]
        yield pd.DataFrame({"key": keys, "n": counts})

    return aligned.select("keys").mapInPandas(count, "key long, n long")


class PairCounts:
    """Sorted shards of (key, documents) in a shared folder, their first keys, and the highest count of each A id.

    The list of shards is as long as the number of partitions; the highest counts are as many as A's vocabulary has ids.
    """

    def __init__(self, folder: str, shards: list[tuple[int, int, str]], best: np.ndarray) -> None:
        self.folder, self.shards, self.best = folder, sorted(shards), best
        self.firsts = np.array([s[0] for s in self.shards], np.int64)
        self.open: dict[int, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": {}}

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Documents of each of the sorted keys; every key has been counted."""
        out = np.zeros(len(keys), np.int64)
        at = self.firsts.searchsorted(keys, "right") - 1
        for i in np.unique(at).tolist():
            if i not in self.open:
                self.open[i] = mapped(self.shards[i][2], self.shards[i][1])
            mine = slice(*at.searchsorted([i, i + 1]))
            out[mine] = self.open[i][1][self.open[i][0].searchsorted(keys[mine])]
        return out


def local_path(path: str) -> str | None:
    """The path of a file in a folder that is mounted on every executor, None for a store."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else None


def written(path: str, keys: np.ndarray, counts: np.ndarray) -> None:
    """Keys and then counts, as little-endian 64-bit integers."""
    if local := local_path(path):
        with open(local, "wb") as f:
            f.write(keys.astype("<i8").tobytes() + counts.astype("<i8").tobytes())
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_output_stream(at) as f:
        f.write(keys.astype("<i8").tobytes() + counts.astype("<i8").tobytes())


def mapped(path: str, n: int) -> np.ndarray:
    """A shard as a memory-mapped array of two rows. From a store it is copied first, to a file without a name."""
    if local := local_path(path):
        return np.memmap(local, "<i8", "r", shape=(2, n))
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f, tempfile.TemporaryFile() as copy:
        while block := f.read(1 << 22):
            copy.write(block)
        copy.flush()
        return np.memmap(copy, "<i8", "r", shape=(2, n))


def pair_counts(spark: SparkSession, partial: DataFrame) -> PairCounts:
    """Add up partial counts: dealt out by ranges of the key and sorted, runs of a key are summed, one file a range.

    A task's file has a name of its own, and only those of tasks that succeeded are listed, so reruns do no harm.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple[np.ndarray, np.ndarray]] = []
        last, last_n = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the run at the end of a batch may go on in the next
        for pdf in batches:
            keys, counts = summed(np.concatenate([last, pdf["key"]]), np.concatenate([last_n, pdf["n"]]))
            done.append((keys[:-1], counts[:-1]))
            last, last_n = keys[-1:], counts[-1:]
        keys, counts = (np.concatenate(x) for x in zip(*done, (last, last_n), strict=True))
        if len(keys):
            file = f"{folder}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
            written(file, keys, counts)
            ids = keys >> ID_BITS
            begins = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            yield pd.DataFrame({"first": keys[0], "size": len(keys), "file": file, "ids": [ids[begins]], "best": [np.maximum.reduceat(counts, begins)]})

    ranges = partial.repartitionByRange(parts, "key").sortWithinPartitions("key")
    shards = ranges.mapInPandas(add, "first long, size long, file string, ids array<long>, best array<long>").collect()
    best = np.zeros(1 + max((max(s["ids"]) for s in shards), default=0), np.int64)
    for s in shards:  # an id may lie in several ranges
        np.maximum.at(best, np.array(s["ids"]), np.array(s["best"]))
    return PairCounts(folder, [(s["first"], s["size"], s["file"]) for s in shards], best)


def with_pair_counts(aligned: DataFrame) -> DataFrame:
    """The rows of ``alignments`` (whatever columns stand beside keys and links) with n_best and count_sum.

    A pair's count is how many documents hold it linked. n_best counts the links whose count is the highest of their A
    id, ties included; count_sum sums the counts over the links. The rows are written once, so texts are encoded once;
    their keys are counted per task and summed by ranges; each task then looks its keys up in the memory-mapped shards,
    so no document's keys are shuffled. What is written besides the result is deleted. An empty table gives no rows.
    """
    spark = aligned.sparkSession
    aligned = stored(aligned, "aligned")
    partial = stored(partial_counts(aligned), "partial")
    counts = pair_counts(spark, partial)
    names = [c for c in aligned.columns if c not in ("keys", "links")]

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["keys"].map(len).to_numpy(np.int64)
            keys = np.concatenate([np.zeros(0, np.int64), *pdf["keys"]])
            links = np.concatenate([np.zeros(0, np.int64), *pdf["links"]])
            distinct, place = np.unique(keys, return_inverse=True)
            n = counts.of(distinct)
            is_best = n == counts.best[distinct >> ID_BITS]
            upto = np.append(0, sizes.cumsum())
            sums = lambda x: np.diff(np.append(0, x.cumsum())[upto])
            yield pdf[names].assign(n_best=sums(links * is_best[place]), count_sum=sums(links * n[place]))

    schema = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in names)
    result = stored(aligned.mapInPandas(look_up, f"{schema}, n_best long, count_sum long"), "counted")
    discard(aligned, partial)
    remove_folder(spark, counts.folder)
    return result
