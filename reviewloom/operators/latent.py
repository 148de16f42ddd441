"""Latent text vectors: a randomized range finder on sparse term weights, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.sources import cut

#: Nonzero weights that are multiplied at once; their products take this many rows of the basis.
NONZERO = 32_768
#: Of these so many at a time, so that their products stay in a core's cache.
AT_ONCE = 1024
#: Terms whose rows of a product are summed as one block.
BLOCK_TERMS = 1024
#: Documents that make one triangle at the leaves of the tree of QR steps.
LEAF_ROWS = 4096
#: Terms in at least this part of the training documents are multiplied as a dense matrix: they are few and hold half of all weights.
COMMON = 0.01


class Basis:
    """Term weights learned on training rows: the vocabulary, its idf, singular values, and a vector per term."""

    def __init__(self, terms: list[str], idf: np.ndarray, values: np.ndarray, vectors: np.ndarray, share: float) -> None:
        self.terms, self.idf, self.values, self.vectors, self.share = terms, idf, values, vectors, share


class Rows:
    """A stretch of sparse rows of about NONZERO weights: a dense matrix of the common terms, and the other weights."""

    def __init__(self, sizes: np.ndarray, at: np.ndarray, weight: np.ndarray, spot: np.ndarray, common: int) -> None:
        self.n = len(sizes)
        row, place = np.repeat(np.arange(self.n), sizes), spot[at]
        there = place >= 0
        self.dense = np.zeros((self.n, common))
        self.dense[row[there], place[there]] = weight[there]
        self.row, self.at, self.weight = row[~there], at[~there], weight[~there, None]

    def times(self, basis: np.ndarray, some: np.ndarray) -> np.ndarray:
        """The rows times a dense matrix, of which ``some`` are the rows of common terms."""
        out = self.dense @ some
        for i in range(0, len(self.row), AT_ONCE):
            row = self.row[i : i + AT_ONCE]
            begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            part = basis[self.at[i : i + AT_ONCE]]
            part *= self.weight[i : i + AT_ONCE]
            out[row[begins]] += np.add.reduceat(part, begins, axis=0)
        return out

    def back(self, y: np.ndarray, sums: np.ndarray, some: np.ndarray) -> None:
        """Adds the transposed rows times ``y`` to ``sums``, and those of common terms to ``some``.

        Most of the other terms stand once or twice in a stretch: the first four weights of each are added in turn, so that
        no term stands twice in an addition, and only what is left is summed by term.
        """
        some += self.dense.T @ y
        order = self.at.argsort(kind="stable")
        row, at, weight = self.row[order], self.at[order], self.weight[order]
        begins = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
        nth = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
        for n in range(5):
            turn = np.flatnonzero(nth == n if n < 4 else nth >= n)
            for i in range(0, len(turn), AT_ONCE):
                now = turn[i : i + AT_ONCE]
                part, terms = y[row[now]], at[now]
                part *= weight[now]
                if n == 4:
                    begins = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
                    part, terms = np.add.reduceat(part, begins, axis=0), terms[begins]
                sums[terms] += part


def _stretches(batches: Iterator[pa.RecordBatch], spot: np.ndarray, common: int) -> Iterator[tuple[pa.RecordBatch, Rows]]:
    for batch in batches:
        sizes = pc.list_value_length(batch.column("at")).to_numpy()
        at, weight = (batch.column(c).flatten().to_numpy() for c in ("at", "weight"))
        upto, start = sizes.cumsum(), 0
        while start < len(sizes):
            before = upto[start] - sizes[start]
            end = max(start + 1, int(upto.searchsorted(before + NONZERO, "right")))
            yield batch.slice(start, end - start), Rows(sizes[start:end], at[before : upto[end - 1]], weight[before : upto[end - 1]], spot, common)
            start = end


def _shared(rows: DataFrame, basis: np.ndarray, common: np.ndarray | None):
    """(broadcast basis, places of common terms in it, and where each term is among these or -1)."""
    common = np.zeros(0, int) if common is None else common
    spot = np.full(len(basis), -1, np.int32)
    spot[common] = np.arange(len(common))
    return rows.sparkSession.sparkContext.broadcast((np.ascontiguousarray(basis), common, spot))


def _numbers(columns: dict[str, list], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), types, strict=True)], names=list(columns))


def gathered(rows: DataFrame, basis: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
    """A transposed times A times the basis: each task multiplies its rows twice and sums by term; blocks of terms are
    added up in their own tasks and fetched once, as large as the basis itself.

    A task hands on a whole basis, so there are no more tasks than run at a time, however many rows there are.
    """
    shared = _shared(rows, basis, common)
    n, width = basis.shape
    types = [pa.int32(), pa.binary()]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, common, spot = shared.value
        sums, some, few = np.zeros((n, width)), np.zeros((len(common), width)), z[common]
        for _, part in _stretches(batches, spot, len(common)):
            part.back(part.times(z, few), sums, some)
        sums[common] += some
        for b in np.unique(np.flatnonzero(sums.any(axis=1)) // BLOCK_TERMS).tolist():
            yield _numbers({"block": [b], "sums": [sums[b * BLOCK_TERMS : (b + 1) * BLOCK_TERMS].tobytes()]}, types)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, s in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
                s = np.frombuffer(s.as_buffer(), np.float64)
                sums[b] = sums[b] + s if b in sums else s.copy()
        for b, s in sums.items():
            yield _numbers({"block": [b], "sums": [s.tobytes()]}, types)

    schema, tasks = "block int, sums binary", rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.select("at", "weight").coalesce(tasks).mapInArrow(multiply, schema).repartition("block").mapInArrow(add, schema).collect()
    out = np.zeros((n, width))
    for p in parts:
        s = np.frombuffer(p["sums"], np.float64).reshape(-1, width)
        out[p["block"] * BLOCK_TERMS : p["block"] * BLOCK_TERMS + len(s)] = s
    shared.unpersist()
    return out


def triangle(rows: DataFrame, basis: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
    """R of the QR of A times the basis: leaves of LEAF_ROWS documents, then the
    triangles of all tasks are stacked and reduced in 64 tasks, theirs in 8, and those here."""
    shared = _shared(rows, basis, common)
    width = basis.shape[1]
    out = lambda r: _numbers({"r": [np.ascontiguousarray(r).tobytes()]}, [pa.binary()])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, common, spot = shared.value
        r, held, count, few = np.zeros((0, width)), [], 0, z[common]
        for _, part in _stretches(batches, spot, len(common)):
            held.append(part.times(z, few))
            count += part.n
            if count >= LEAF_ROWS:
                r, held, count = np.linalg.qr(np.concatenate([r, *held]), mode="r"), [], 0
        yield out(np.linalg.qr(np.concatenate([r, *held]), mode="r") if held or len(r) else r)

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for x in batch.column("r").to_pylist():
                r = np.linalg.qr(np.concatenate([r, np.frombuffer(x, np.float64).reshape(-1, width)]), mode="r")
        yield out(r)

    found = rows.select("at", "weight").mapInArrow(leaf, "r binary")
    for tasks in (64, 8):
        found = found.repartition(tasks).mapInArrow(stack, "r binary")
    parts = [np.frombuffer(x["r"], np.float64).reshape(-1, width) for x in found.collect()]  # eight triangles at most
    shared.unpersist()
    return np.linalg.qr(np.concatenate([np.zeros((0, width)), *parts]), mode="r")


def singular_vectors(rows: DataFrame, n_terms: int, k: int, more: int = 16, powers: int = 6, seed: int = 42, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, n_terms by k right singular vectors) of the rows, the largest first.

    A random range of k + ``more`` columns is refined by ``powers`` passes, each made orthonormal; the triangle of its
    image then gives the values without squaring them. Signs are such that each vector's largest entry is positive.
    ``common`` has the places of terms that many rows have.
    """
    k = min(k, n_terms)
    z = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_terms, min(k + more, n_terms))))[0]
    for _ in range(powers):
        z = np.linalg.qr(gathered(rows, z, common))[0]
    _, values, turn = np.linalg.svd(triangle(rows, z, common), full_matrices=False)
    vectors = (z @ turn.T)[:, :k]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return values[:k], vectors


def projected(rows: DataFrame, vectors: np.ndarray, id_col: str, common: np.ndarray | None = None) -> DataFrame:
    """(id, vector): each row's coordinates on the singular vectors."""
    shared = _shared(rows, vectors, common)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, common, spot = shared.value
        few = z[common]
        for batch, part in _stretches(batches, spot, len(common)):
            y = part.times(z, few)
            ends = pa.array(np.arange(part.n + 1) * y.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names=[id_col, "vector"])

    return rows.select(id_col, "at", "weight").mapInArrow(project, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, vector array<double>")


def learned(docs: DataFrame, train: DataFrame, k: int = 128, id_col: str = "doc_id", text_col: str = "text", **vocabulary) -> tuple[DataFrame, Basis]:
    """((id, vector), basis): TF-IDF of the training documents' vocabulary, reduced to ``k`` dimensions learned on them.

    Documents without a known term have no row. What reaches the driver is the vocabulary and a matrix of as many rows,
    both bounded by ``max_features``; documents' rows never do. share is the part of the training rows' sum of squares
    that the dimensions hold. Texts are dealt out once, by id, beside whether they are of the training ones, so neither the
    count of terms nor a pass over the weights asks for that again or is bound to the parts of the input's file.
    """
    from reviewloom.operators import matrix

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    marks = train.select(id_col).distinct().withColumn("fit", F.lit(True))
    docs = cut(docs.select(id_col, text_col).repartition(tasks, id_col).join(marks, id_col, "left"))
    known = matrix.known_terms(docs.where("fit").select(id_col, text_col), id_col, text_col, **vocabulary)
    idf = [(r["term"], r["idf"]) for r in known.orderBy("term").collect()]
    terms, idf = [t for t, _ in idf], np.array([x for _, x in idf])
    common = np.flatnonzero(np.exp(1 - idf) >= COMMON)  # by the share of training documents, of which idf is made
    fit, others = (cut(matrix.weight_rows(docs.where(which), terms, idf, id_col, text_col)) for which in ("fit", "fit IS NULL"))
    values, vectors = singular_vectors(fit, len(terms), k, common=common) if terms else (np.zeros(0), np.zeros((0, 0)))
    whole = fit.agg(F.sum(F.aggregate("weight", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    return projected(fit.unionByName(others), vectors, id_col, common), Basis(terms, idf, values, vectors, float((values**2).sum() / whole) if whole else 0.0)
