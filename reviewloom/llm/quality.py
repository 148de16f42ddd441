"""Quality rules: an isolation forest on rule statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import discard, prepare, stored

TREES, TREE_ROWS, DEPTH = 100, 256, 10
#: The forest is grown from this many documents labelled good at most, those of smallest hashed id among the even hashes;
#: the rows of odd hashes set the threshold. Bad ones come in clusters, which a forest grown among them would take for
#: normal.
FIT_ROWS = 8192
#: The threshold may reject at most this share of the labelled good documents.
MOST_GOOD_LOST = 0.005
SCORE_BINS = 1000
MIN_WORDS = 50
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "digit_share", "long_word_share"]
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
#: ASCII punctuation but for what ends clauses and joins words.
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'-")


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more, each word once."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    n, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + 3 - max(i, upto)
            upto = i + 3
    return n


def text_statistics(text: str | None) -> list[float]:
    """BASE, then FEATURES, of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # ASCII white space, as bytes are split
    n = len(words)
    if not n:
        return [0, 0, sum(map(text.count, "#*$%&|<>")), 0, 0] + [0.0] * len(FEATURES)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    share = lambda kind: (len(raw) - len(raw.translate(None, kind))) / chars
    long_words = sum(1 for w in words if len(w) > 24)
    return [n, chars, symbols, dup_lines, repeats, chars / n, symbols / chars, dup_lines / max(1, len(lines)), repeats / n, share(_UPPER), share(_MARKS), share(_DIGITS), long_words / n]


def quality_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, and the forest's features of every whole text. A null text counts as empty."""
    prepare(docs.sparkSession)
    names = BASE + FEATURES

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([text_statistics(t) for t in pdf["text"]], columns=names).astype(dict.fromkeys(BASE, "int64"))
            out.insert(0, "doc_id", pdf["doc_id"])
            yield out

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(count, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in BASE) + ", " + ", ".join(f"{c} double" for c in FEATURES))


def _depth_left(n: float) -> float:
    """Mean path length of a failed search in a binary search tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow_forest(rows: np.ndarray, reach: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, depth: int = DEPTH, seed: int = 7) -> dict[str, np.ndarray]:
    """Isolation trees as arrays [tree, node]: feature (-1: leaf), cut, left child (right: + 1), path length at a leaf.

    Cuts are drawn within the box that ``reach`` (least and greatest values of rows of all sorts) spans, not within the fitted rows' own range: a rule
    that hardly any good document breaks has no range there, and its breakers must end in an empty branch at once.
    """
    rng = np.random.default_rng(seed)
    size = min(tree_rows, len(rows))
    room = 2 ** (depth + 1)
    out = {"feature": np.full((trees, room), -1, np.int16), "cut": np.zeros((trees, room)), "left": np.zeros((trees, room), np.int32), "path": np.zeros((trees, room)), "scale": np.array(_depth_left(size) or 1.0)}
    low, high = reach.min(axis=0), reach.max(axis=0)
    for t in range(trees):
        todo, used = [(0, rng.choice(len(rows), size, replace=False), 0, low, high)], 1
        while todo:
            node, own, at, lo, hi = todo.pop()
            features = np.flatnonzero(hi > lo)
            if at >= depth or len(own) <= 1 or not len(features):
                out["path"][t, node] = at + _depth_left(len(own))
                continue
            f = rng.choice(features)
            cut = rng.uniform(lo[f], hi[f])
            side = rows[own, f] <= cut
            out["feature"][t, node], out["cut"][t, node], out["left"][t, node] = f, cut, used
            below, above = hi.copy(), lo.copy()
            below[f] = above[f] = cut
            todo += [(used, own[side], at + 1, lo, below), (used + 1, own[~side], at + 1, above, hi)]
            used += 2
    return out


def forest_scores(forest: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """2 ** -(mean path length / mean of a failed search): near 1 for rows that random splits isolate soon."""
    total, every = np.zeros(len(rows)), np.arange(len(rows))
    for feature, cut, left, path in zip(forest["feature"], forest["cut"], forest["left"], forest["path"], strict=True):
        node, live = np.zeros(len(rows), np.int32), every
        while len(live):
            at = node[live]
            f = feature[at]
            live, at, f = live[f >= 0], at[f >= 0], f[f >= 0]
            node[live] = left[at] + (rows[live, f] > cut[at])
        total += path[node]
    return 2.0 ** (-total / max(1, len(forest["path"])) / float(forest["scale"]))


def score_documents(stats: DataFrame, forest: dict[str, np.ndarray] | None) -> DataFrame:
    """Adds score, 0 without a forest."""
    if forest is None:
        return stats.withColumn("score", F.lit(0.0))

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest_scores(forest, np.column_stack([c.to_numpy(float) for c in columns])))

    return stats.withColumn("score", score(*FEATURES))


def calibrated_threshold(scored: DataFrame, labels: DataFrame, most_good_lost: float = MOST_GOOD_LOST) -> float:
    """The score from which documents are rejected: most bad less good ones, with at most a set share of the good lost.

    Every labelled row counts, in a histogram of SCORE_BINS bins. Without labels of both kinds nothing is rejected.
    """
    bins = scored.join(labels, "doc_id").groupBy(F.floor(F.col("score") * SCORE_BINS).cast("int").alias("bin"), F.col("quality").cast("int").alias("quality")).count()
    table = np.zeros((2, SCORE_BINS + 2))
    for r in bins.collect():  # at most two rows per bin
        if r["bin"] is not None and r["quality"] in (0, 1):
            table[r["quality"], r["bin"]] += r["count"]
    if not table[0].sum() or not table[1].sum():
        return math.inf
    above = table[:, ::-1].cumsum(axis=1)[:, ::-1] / table.sum(axis=1, keepdims=True)  # share of each kind from a bin on
    gain = np.where(above[1] <= most_good_lost, above[0] - above[1], -1.0)
    return float(np.argmax(gain)) / SCORE_BINS


def fitted(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[dict[str, np.ndarray] | None, float]:
    """The forest and its threshold from ``quality_statistics`` and the labels; no forest with fewer than two rows to grow it."""
    marks = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    passing = stats.where(~base_failed())
    even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    good = passing.where(even).join(marks.where("quality = 1"), "doc_id", "left_semi")
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(fit_rows).select(*FEATURES).toPandas().to_numpy(float)
    if len(chosen) < 2:
        return None, math.inf
    ends = passing.agg(*[F.min(c) for c in FEATURES], *[F.max(c) for c in FEATURES]).first()
    forest = grow_forest(chosen, np.array(ends, float).reshape(2, -1))
    return forest, calibrated_threshold(score_documents(passing.where(~even), forest).select("doc_id", "score"), marks)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_forest(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Judge every document by fixed base rules and by an isolation forest on its rule statistics.

    ``labels`` has doc_id and quality (1 good, 0 bad; other values do not count). Returns doc_id, BASE, base_failed
    (under 50 words, or over half of the words repeat), kept (false if base_failed, else the forest's verdict), score.

    The forest is fitted on ``fit_rows`` rows at most among those labelled good that pass the base rules, half of which
    are held out for the threshold with the labelled bad ones; the range of each statistic and the scores cover all rows.
    A null or empty text fails the base rules. With fewer than two rows to fit on, or no held-out labels of both kinds,
    the base rules alone decide. Repeated rows are judged one by one.
    """
    stats = stored(quality_statistics(docs, id_col, text_col), "quality")
    forest, threshold = fitted(stats, labels, fit_rows)
    failed = base_failed()
    kept = ~failed & (F.col("score") < threshold)
    return score_documents(stats, forest).select("doc_id", *BASE, failed.alias("base_failed"), kept.alias("kept"), "score")


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all input columns, that ``quality_forest`` keeps: each row by its own text, whatever its id.

    Statistics are stored for the fit only; the verdict is computed again beside each row, so texts are never shuffled
    and rows with null or shared ids need no way back.
    """
    stats = stored(quality_statistics(docs, id_col, text_col), "quality")
    forest, threshold = fitted(stats, labels)
    discard(stats)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        rows = np.array([text_statistics(t) for t in texts], float).reshape(len(texts), -1)
        n, repeats = rows[:, 0], rows[:, BASE.index("n_repeat_words")]
        passed = (n >= MIN_WORDS) & (100 * repeats <= 50 * n)
        if forest is not None:
            passed[passed] = forest_scores(forest, rows[passed, len(BASE) :]) < threshold
        return pd.Series(passed)

    return docs.where(good(F.col(text_col).cast("string")))
