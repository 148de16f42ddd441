"""Near-duplicate documents by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import discard, prepare, stored
from reviewloom.llm.components import connected_components

SHINGLE_WORDS = 5
#: Percent of the union that the intersection must reach.
SIMILARITY = 75
#: Bands and rows: two sets at similarity 0.75 share no band with a chance of 6e-9, (1 - 0.75 ** 4) ** 50.
BANDS, BAND_ROWS = 50, 4
_CACHED_WORDS = 1 << 19


def text_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def exact_shingles(words: list[bytes], k: int = SHINGLE_WORDS) -> set[tuple]:
    """The distinct k-word shingles; with fewer words, the whole sequence as one; none without words."""
    return set(zip(*[words[i:] for i in range(k)], strict=False)) if len(words) >= k else {tuple(words)} if words else set()


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], known: dict, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a text."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([known[w] for w in words], np.uint64)
    n = max(1, len(h) - k + 1)
    total = np.zeros(n, np.uint64)
    factor = 1
    for i in range(min(k, len(h))):
        factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
        total += h[i : i + n] * np.uint64(factor)
    return np.unique(mixed(total + np.uint64(len(words) if len(words) < k else k)))


def similarity_sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch (Dahlgaard, Knudsen and Thorup, 2017) of a non-empty set of hashed elements.

    In round i each element falls into a hashed bin with value i + v, v hashed in [0, 1); a bin keeps its smallest value.
    In rounds size to 2 * size - 1 all elements fall into bin i - size, so every bin is filled. Rounds stop once all bins
    are; later ones could not lower a value. Rounds are taken several at a time for small sets. Values are integers,
    the round above 32 bits of v.
    """
    empty = np.iinfo(np.uint64).max
    sketch = np.full(size, empty, np.uint64)
    done, most = 0, 2 * size
    step = max(1, int(size * (np.log(size) + 1.5) / len(elements)))
    while done < most:
        rounds = np.arange(done, min(most, done + step), dtype=np.uint64)
        h = mixed(elements[None, :] ^ mixed(rounds * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))[:, None])
        value = (rounds[:, None] << np.uint64(32)) | (h >> np.uint64(32))
        bins = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(size)) >> np.uint64(32)
        late = rounds >= size
        bins[late] = (rounds[late] - np.uint64(size))[:, None]
        np.minimum.at(sketch, bins.ravel().astype(np.intp), value.ravel())
        done += len(rounds)
        if not (sketch == empty).any():
            break
        step = max(1, step // 2)
    return sketch


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, of its rows and its place."""
    s = mixed(sketch.reshape(bands, rows) + np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    key = np.zeros(bands, np.uint64)
    for i in range(rows):
        key = mixed(key ^ s[:, i])
    return mixed(key + np.arange(bands, dtype=np.uint64)).view(np.int64)


def sketched(docs: DataFrame, bands: int, rows: int, k: int) -> DataFrame:
    """From (id, text, print): id, print, the set size, a digest of the words, and the band keys of each text."""
    prepare(docs.sparkSession)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHashes()
        with np.errstate(over="ignore"):
            for pdf in batches:
                sizes, same, keys = [], [], []
                for text in pdf["text"]:
                    words = text_words(text)
                    elements = shingle_hashes(words, known, k)
                    sizes.append(len(elements))
                    same.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                    keys.append(band_keys(similarity_sketch(elements, bands * rows), bands, rows) if words else None)
                yield pd.DataFrame({"id": pdf["id"], "print": pdf["print"], "n_shingles": sizes, "same": same, "keys": keys})

    return docs.mapInPandas(sketch, "id long, print long, n_shingles long, same binary, keys array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, similarity: int, k: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity. One batch of pairs is in memory at a time."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = None, set()
        for pdf in batches:
            keep = []
            for a, text_a, text_b in zip(pdf["a"], pdf["text_a"], pdf["text_b"], strict=True):
                if a != last:
                    last, left = a, exact_shingles(text_words(text_a), k)
                right = exact_shingles(text_words(text_b), k)
                both = len(left & right)
                keep.append(100 * both >= similarity * (len(left) + len(right) - both))
            yield pdf.loc[keep, ["a", "b"]]

    met = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return met.select("a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long")


def signatures(texts: DataFrame, k: int) -> DataFrame:
    """(id, level, signature, folded): a bitmap of the hashed shingles of each text, as longs.

    2 ** level bits, at least 8 and fewer than 16 for each shingle; bit h modulo that is set for a shingle of hash h.
    ``folded`` has half as many bits: the same bitmap at the level below.
    """

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHashes()
        with np.errstate(over="ignore"):
            for pdf in batches:
                out = []
                for doc, text in zip(pdf["id"], pdf["text"], strict=True):
                    h = shingle_hashes(text_words(text), known, k)
                    level = max(7, (8 * len(h) - 1).bit_length())
                    bits = np.zeros(1 << level, np.uint8)
                    bits[(h & np.uint64((1 << level) - 1)).astype(np.intp)] = 1
                    whole, half = (np.packbits(x, bitorder="little").view(np.int64) for x in (bits, bits[: len(bits) // 2] | bits[len(bits) // 2 :]))
                    out.append((doc, level, whole, half))
                yield pd.DataFrame(out, columns=["id", "level", "signature", "folded"])

    return texts.select("id", "text").mapInPandas(drawn, "id long, level int, signature array<long>, folded array<long>")


def may_reach(x: str, y: str, similarity: int) -> Column:
    """Whether the sets of two signature rows can reach the similarity: never false for sets that do.

    Each bit that one bitmap has and the other lacks stands for one element at least that the other set lacks, so the
    intersection is at most either set's size less the count of such bits.
    """
    of = lambda side, name: F.col(f"{side}.{name}")
    at = lambda side, other: F.when(of(side, "level") > of(other, "level"), of(side, "folded")).otherwise(of(side, "signature"))
    lacking = lambda a, b: F.aggregate(F.zip_with(at(a, b), at(b, a), lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))), F.lit(0), lambda s, c: s + c)
    near_size = 100 * F.least(of(x, "n"), of(y, "n")) >= similarity * F.greatest(of(x, "n"), of(y, "n"))
    enough = lambda a, b: (100 + similarity) * (of(a, "n") - lacking(a, b)) >= similarity * (of(x, "n") + of(y, "n"))
    return near_size & enough(x, y) & enough(y, x)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, shingle_words: int = SHINGLE_WORDS, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of their word shingles of ``similarity`` percent or more.

    Returns doc_id (as given), n_shingles, component_id (smallest id reachable, itself included), kept (doc_id =
    component_id). Null, empty and wordless texts have no shingles and link with nothing. Rows with a null id link with
    nothing and are kept, with a null component. Of rows that share an id the text of the smallest digest stands for the
    id in links; each row with the words of a class belongs to it. Ids of any type that orders are taken.

    Texts of equal words form a class, of which the smallest id alone is banded. Of each band bucket every member is
    checked against the bucket's smallest id on full sets, so a bucket of m copies costs m checks. In buckets that this
    leaves in several components, every member outside the most frequent one meets all members of other components, so no
    link that a shared band offers is lost; of these pairs only those whose bitmaps leave the similarity within reach
    (``may_reach``) leave the join and are checked on full sets.
    """
    given = docs.select(F.col(id_col).alias("given"), F.col(text_col).cast("string").alias("text"))
    whole = given.schema["given"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if whole:
        rows = given.select(F.col("given").cast("long").alias("id"), "text")
        names = None
    else:  # number ids of other types in their order; only ids are sorted
        names = numbered(given.select("given").where("given IS NOT NULL").distinct())
        rows = given.join(names, "given", "left").select("id", "text")
    rows = rows.withColumn("print", F.xxhash64("text"))
    all_rows = stored(sketched(rows, bands, band_rows, shingle_words), "sketch")
    worded = all_rows.where("same IS NOT NULL AND id IS NOT NULL")
    classes = worded.groupBy("same").agg(F.min("id").alias("rep"))
    reps = worded.join(classes, (worded["same"] == classes["same"]) & (worded["id"] == classes["rep"]), "left_semi").groupBy("id").agg(F.min_by(F.struct("print", "n_shingles", "keys"), F.struct("same", "print")).alias("r")).select("id", "r.*")
    in_band = reps.select("id", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    buckets = in_band.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("members")).where("members > 1").select("key", "hub")
    members = stored(in_band.join(buckets, "key"), "buckets")
    wanted = reps.join(members.select("id").distinct(), "id", "left_semi").select("id", "print")
    texts = stored(rows.join(wanted, ["id", "print"], "left_semi").dropDuplicates(["id"]), "texts")
    sized = members.select("id", "n").distinct()
    near_size = lambda x, y: 100 * F.least(x, y) >= similarity * F.greatest(x, y)
    stars = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"), "n").distinct()
    stars = stars.join(sized.select(F.col("id").alias("a"), F.col("n").alias("n_a")), "a").where(near_size(F.col("n"), F.col("n_a"))).select("a", "b")
    links = stored(confirmed(stars, texts, similarity, shingle_words), "links")
    parts = connected_components(links)
    placed = members.join(parts, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed_buckets = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_rows = open_stored = stored(placed.join(mixed_buckets, "key", "left_semi"), "open")
    counts = open_rows.groupBy("key", "component").agg(F.count("*").alias("c"))
    most = counts.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("most"))
    drawn = stored(signatures(texts.join(open_rows.select("id").distinct(), "id", "left_semi"), shingle_words), "signatures")
    open_rows = open_rows.join(drawn, "id").join(most, "key")
    # Both sides of the join are alike, so that one shuffle serves both.
    apart = (F.col("x.component") != F.col("x.most")) & (F.col("x.component") != F.col("y.component"))
    crossed = open_rows.alias("x").join(open_rows.alias("y"), (F.col("x.key") == F.col("y.key")) & apart & may_reach("x", "y", similarity))
    crossed = crossed.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    more = confirmed(crossed.join(links, ["a", "b"], "left_anti"), texts, similarity, shingle_words)
    parts = stored(connected_components(links.unionByName(more)), "parts")
    discard(members, texts, links, open_stored, drawn)
    final = classes.join(parts, classes["rep"] == parts["id"], "left").select("same", F.coalesce("component", "rep").alias("component"))
    found = all_rows.join(final, "same", "left").withColumn("component_id", F.coalesce("component", "id"))
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    out = found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))
    if names is None:
        return out
    own, root = names.select(F.col("id").alias("doc_id"), F.col("given").alias("own")), names.select(F.col("id").alias("component_id"), F.col("given").alias("root"))
    return out.join(own, "doc_id", "left").join(root, "component_id", "left").select(F.col("own").alias("doc_id"), "n_shingles", F.col("root").alias("component_id"), "kept")


def numbered(ids: DataFrame) -> DataFrame:
    """(given, id): distinct values and their places in order, from a range partitioning and the counts before each part."""
    parts = stored(ids.repartitionByRange("given").sortWithinPartitions("given").select("given", F.spark_partition_id().alias("part")), "ids")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))  # a row per partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("given"))
    return stored(parts.withColumn("inside", inside).join(before, "part").select("given", (F.col("before") + F.col("inside")).alias("id")), "numbers")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all input columns, without those that a near duplicate of smaller id stands for.

    Rows that share an id are near duplicates of themselves only and stay together; rows with a null id stay.
    """
    gone = near_duplicates(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_gone_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    # Rows with a null id stay out of the join, where one task would get them all.
    named, nameless = rows.where(F.col("row")[id_col].isNotNull()), rows.where(F.col("row")[id_col].isNull())
    return named.join(gone, F.col("row")[id_col] == F.col("_gone_id"), "left_anti").unionByName(nameless).select("row.*")
