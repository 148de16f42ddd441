"""Language identification with error-correcting output codes over n-gram classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import prepare

#: Hashed n-gram buckets; n-grams are of 1 to 3 bytes of the lower-cased text, a space for runs of ASCII that is no letter.
BUCKETS = 1 << 12
#: Bits of a codeword: as many for each doubling of the number of languages, and at least.
BITS_PER_DOUBLING, LEAST_BITS = 8, 15
#: A prediction is ambiguous if its probability leads the next by less.
AMBIGUOUS_LEAD = 0.2
UNKNOWN = "und"


def clean_bytes(text: str) -> np.ndarray:
    """The text lower-cased, as UTF-8 bytes, each run of ASCII characters that are no letters as one space."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    letter = (raw >= 128) | ((raw >= 97) & (raw <= 122))
    raw = np.where(letter, raw, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return raw[keep].astype(np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of a whole text."""
    b = clean_bytes(text)
    grams = [b * np.uint32(0x9E3779B1) + np.uint32(1)]
    if len(b) > 1:
        pairs = b[:-1] * np.uint32(257) + b[1:]
        grams.append(pairs * np.uint32(0x85EBCA6B) + np.uint32(2))
        if len(b) > 2:
            grams.append((pairs[:-1] * np.uint32(257) + b[2:]) * np.uint32(0xC2B2AE35) + np.uint32(3))
    h = np.concatenate(grams)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.bincount(h >> np.uint32(32 - 12), minlength=BUCKETS)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1, far apart; every column splits the rows (for two rows or more)."""
    if n < 2:
        return np.ones((n, 1))
    bits = max(LEAST_BITS, BITS_PER_DOUBLING * int(np.ceil(np.log2(n))))
    rng, best, far = np.random.default_rng(5), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, bits))
        for j in range(bits):
            while abs(code[:, j].sum()) == n:
                code[:, j] = rng.choice([-1.0, 1.0], n)
        gap = int(bits - (code @ code.T - 2 * bits * np.eye(n)).max()) // 2  # least distance of two rows
        if gap > far:
            best, far = code, gap
    return best


class Model:
    """Codewords, a linear classifier per bit, and each bit's weight in decoding."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        self.code = codewords(len(self.languages))
        table = np.array([counts[x] for x in self.languages], float).reshape(len(self.languages), BUCKETS)
        rates = (table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        # Each bit separates the languages with +1 from those with -1, every language weighing the same on its side.
        side = lambda s: np.stack([rates[self.code[:, j] == s].mean(axis=0) if (self.code[:, j] == s).any() else rates.mean(axis=0) for j in range(self.code.shape[1])])
        self.weights = (np.log(side(1)) - np.log(side(-1))).T if len(self.languages) else np.zeros((BUCKETS, 1))
        # A bit counts by how far it holds the languages' own mean margins apart from zero.
        margins = rates @ self.weights * self.code
        least = np.maximum(margins.min(axis=0), 1e-6) if len(self.languages) > 1 else np.ones(self.code.shape[1])
        self.bit_weights = least / least.sum() if len(least) else least

    def decode(self, counts: np.ndarray) -> tuple[str, float, bool]:
        """Language, probability and ambiguity from one text's n-gram counts: the codeword of least weighted loss."""
        if len(self.languages) < 2:
            return (self.languages[0], 1.0, False) if self.languages else (UNKNOWN, 0.0, True)
        margin = counts @ self.weights / 3.0  # about one n-gram of each length per letter
        loss = np.logaddexp(0.0, -margin * self.code) @ self.bit_weights
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return self.languages[order[0]], float(p[order[0]]), bool(p[order[0]] - p[order[1]] < AMBIGUOUS_LEAD)


def train(labelled: DataFrame) -> Model:
    """Fit on all rows of (text, lang): n-gram counts are added up by language, first inside each task.

    What reaches the driver is BUCKETS numbers per language, whatever the number of rows.
    """
    prepare(labelled.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        with np.errstate(over="ignore"):
            for pdf in batches:
                for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                    c = ngram_counts(text)
                    sums[lang] = sums[lang] + c if lang in sums else c.astype(np.int64)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": c[at]})

    totals = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInPandas(count, "lang string, bucket int, n long")
    rows = totals.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        counts.setdefault(r["lang"], np.zeros(BUCKETS))[r["bucket"]] = r["n"]
    return Model(counts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and ambiguous of every whole text; ``und`` and 0 if it is null or has no letter."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for pdf in batches:
                out = [model.decode(ngram_counts(t)) if has_letter(t) else (UNKNOWN, 0.0, True) for t in pdf["text"]]
                made = pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])
                made.insert(0, "doc_id", pdf["doc_id"])
                yield made

    return rows.mapInPandas(predict, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def language_codes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predict the language of all documents with a model of two thirds of them.

    Rows whose crc32 of the id as text leaves 1 modulo 3 are held out of training (a null id counts as empty text).
    Returns doc_id, held_out, lang_pred, score, ambiguous. Without a labelled row every prediction is ``und``.
    """
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1
    model = train(docs.where(~held).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")))
    found = identify(docs, model, id_col, text_col)
    return found.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1).alias("held_out"), "lang_pred", "score", "ambiguous")
