"""Graph networks that learn by full-batch gradient descent: messages go along edges, adjoints back along them.

Nodes are kept in blocks. What a node computes from its own row is numpy inside its block; what crosses an edge to another
block is mail, summed before it leaves where that is less. Weights and their gradients are the only things that reach the
driver: their size depends on the layers' widths, never on the graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators import stats
from reviewloom.sources import Workspace, forget_shuffles

Weights = dict[str, np.ndarray]
ID = "review_id"


class Adam:
    """Adam with decay of the weights; its state is as small as they are."""

    def __init__(self, weights: Weights, rate: float = 1e-3, decay: float = 1e-4, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> None:
        self.rate, self.decay, self.b1, self.b2, self.eps, self.steps = rate, decay, b1, b2, eps, 0
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))

    def step(self, weights: Weights, gradients: Weights) -> Weights:
        self.steps += 1
        out = {}
        for k, w in weights.items():
            g = gradients.get(k, 0.0) + self.decay * w
            self.mean[k] = self.b1 * self.mean[k] + (1 - self.b1) * g
            self.square[k] = self.b2 * self.square[k] + (1 - self.b2) * g * g
            m, s = self.mean[k] / (1 - self.b1**self.steps), self.square[k] / (1 - self.b2**self.steps)
            out[k] = w - self.rate * m / (np.sqrt(s) + self.eps)
        return out


def glorot(rng: np.random.Generator, *shape: int) -> np.ndarray:
    bound = np.sqrt(6 / (shape[0] + shape[-1]))
    return rng.uniform(-bound, bound, shape)


def kept(ids: np.ndarray, width: int, salt: int, share: float) -> np.ndarray:
    """Dropout factors, 0 or 1 / (1 - share), by id, unit and salt alone: a retried task and the way back draw the same."""
    if share <= 0:
        return np.ones((len(ids), width))
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(salt) * np.uint64(0x94D049BB133111EB)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(np.float64) / 2.0**53 >= share) / (1 - share)


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """An array column as a matrix; a null as zeros."""
    if column.isna().any():
        column = pd.Series([np.zeros(width) if v is None else v for v in column], dtype=object)
    return np.concatenate(column.to_list(), dtype=np.float64).reshape(len(column), width) if len(column) else np.zeros((0, width))


class Sums:
    """Gradients that a task adds up over its batches and hands on once."""

    def __init__(self) -> None:
        self.of: Weights = {}

    def add(self, **parts: np.ndarray) -> None:
        for k, v in parts.items():
            self.of[k] = self.of[k] + v if k in self.of else np.asarray(v, np.float64)

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"name": list(self.of), "values": [np.ravel(v) for v in self.of.values()]}, dtype=object)


GRADIENTS = "name string, values array<double>"


def summed_gradients(rows: DataFrame, weights: Weights) -> tuple[float, Weights]:
    """(loss, gradients): each weight's parts meet in one task, as many as there were tasks, and one row of each is fetched."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = Sums()
        for pdf in batches:
            for name, values in zip(pdf["name"], pdf["values"], strict=True):
                sums.add(**{name: values})
        yield sums.rows()

    found = {r["name"]: np.array(r["values"]) for r in rows.where("name IS NOT NULL").select("name", "values").repartition("name").mapInPandas(add, GRADIENTS).collect()}
    return float(found.get("loss", np.zeros(1))[0]), {k: found[k].reshape(w.shape) if k in found else np.zeros_like(w) for k, w in weights.items()}


def summed_blocks(mail: DataFrame, weights: Weights) -> tuple[float, Weights]:
    """(loss, gradients) of what blocks carried out of the last step: each task adds up its blocks' parts first."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = Sums()
        for pdf in batches:
            for name, values in zip(pdf["name"], pdf["payload"], strict=True):
                sums.add(**{name[2:]: np.frombuffer(values, np.float64)})
        yield sums.rows()

    return summed_gradients(mail.select("name", "payload").mapInPandas(add, GRADIENTS), weights)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def loss_of(logits: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray]:
    """Cross entropy summed with each row's share of it, and its gradient in the logits."""
    p = softmax(logits)
    at = np.arange(len(y)), y.astype(np.int64)
    d = p.copy()
    d[at] -= 1
    return float(-(share * np.log(np.maximum(p[at], 1e-300))).sum()), d * share[:, None]


def with_shares(nodes: DataFrame, label: str) -> DataFrame:
    """Adds y and share: a training row's part of the loss, by inverse class frequency; 0 for other rows."""
    train = F.col("split") == "train"
    n = nodes.where(train).groupBy(label).agg(F.count("*").alias("_n"))
    whole = n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_classes"))  # classes weigh all / (2 n), and each row its class's weight over the sum of all
    share = F.when(train, 1.0 / (F.col("_n") * F.col("_classes"))).otherwise(0.0)
    return nodes.join(F.broadcast(n), label, "left").crossJoin(F.broadcast(whole)).withColumns({"share": F.coalesce(share, F.lit(0.0)), "y": F.coalesce(F.col(label), F.lit(0)).cast("double")}).drop("_n", "_all", "_classes")


class _Network:
    def __getstate__(self) -> dict:
        """What tasks get of it: its widths and rates, not the tables it was given."""
        return {k: v for k, v in self.__dict__.items() if k not in ("base", "own")}

    def release(self) -> None:
        """Delete what ``prepare`` wrote."""
        self.own.clear()


#: Nodes of a block, about.
BLOCK = 8_192
#: Tasks of a step for each that runs at a time.
WAVES = 8
#: What blocks send: to themselves what they carry to the next step, to others rows that these are waiting for.
MAIL = "to int, sender int, name string, payload binary"
SENT = "sent"


def added(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows: the sums of the rows of ``values`` that have the same place in ``at``."""
    out = np.zeros((n, values.shape[1]))
    if len(at):
        order = at.argsort(kind="stable")
        begins = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
        out[at[order][begins]] = np.add.reduceat(values[order], begins, axis=0)
    return out


class Block:
    """A block's nodes, its edges to and from each other block, and what it was sent."""

    def __init__(self, row: pd.DataFrame, mail: pd.DataFrame | None) -> None:
        row = row.iloc[0]
        numbers = lambda c, kind: np.frombuffer(row[c], kind) if c in row.index else None
        self.block, self.split = int(row["block"]), row["split"] if "split" in row.index else None
        self.ids, self.y, self.share = numbers("ids", np.int64), numbers("y", np.float64), numbers("share", np.float64)
        self.n = len(self.ids)
        self.x = numbers("x", np.float64).reshape(self.n, -1)
        self.m0, self.degree, self.near = numbers("m0", np.float64), numbers("degree", np.float64), numbers("near", np.int64)
        self.sides = {s: [numbers(f"{s}_{c}", np.int32) for c in ("peer", "rows", "m", "at")] for s in ("out", "in")}
        self.mail = mail

    def send(self, side: str, values: np.ndarray) -> list[tuple]:
        """Mail to the blocks at the other ends of the edges of one side: sums of rows of ``values``, as each needs them."""
        _, rows, m, at = self.sides[side]
        return self.give_back(side, added(m, values[at], int(rows.sum())))

    def came(self, side: str, width: int) -> np.ndarray:
        """What the other ends sent, in the order in which the edges of the side count it."""
        peer, came = self.sides[side][0], self.mail[self.mail["name"] == SENT]
        parts = dict(zip(came["sender"], came["payload"], strict=True))
        return np.frombuffer(b"".join(parts[p] for p in peer), np.float64).reshape(-1, width)

    def take(self, side: str, n: int, width: int) -> np.ndarray:
        """The sums that what the other ends sent makes in ``n`` places."""
        peer, _, m, at = self.sides[side]
        return added(at, self.came(side, width)[m], n) if len(peer) else np.zeros((n, width))

    def give_back(self, side: str, whole: np.ndarray) -> list[tuple]:
        """Mail to the blocks that ``came`` is from: one row for each that they sent."""
        peer, rows, *_ = self.sides[side]
        return [(int(p), self.block, SENT, whole[e - r : e].tobytes()) for p, r, e in zip(peer, rows, np.cumsum(rows), strict=True)]

    def carry(self, **arrays: np.ndarray) -> list[tuple]:
        return [(self.block, self.block, k, np.ascontiguousarray(v, np.float64).tobytes()) for k, v in arrays.items()]

    def carried(self) -> Weights:
        kept = self.mail[self.mail["name"] != SENT]
        return {k: np.frombuffer(v, np.float64) for k, v in zip(kept["name"], kept["payload"], strict=True)}


class Blocks:
    """A graph as a table of blocks of nodes. A pass over it is a chain of steps, each a grouped map over the blocks and the
    mail they got, so a task holds a block and never a table of edges with their ends' columns.

    For the edges from one block to another, either each source's row is sent once, however many edges leave it, or one sum
    for each receiver and relation, whichever are fewer. Nodes of the same ``home``, if there is such a column, share a block
    where they fit, so edges inside a home send nothing. With ``sources`` it is always each source's row, and blocks have the
    ids of these instead of the means of their inputs.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, relations: int, own: Workspace, sources: bool = False) -> None:
        self.relations, self.placed = relations, False
        self.count = max(1, -(-nodes.count() // BLOCK))
        context = nodes.sparkSession.sparkContext
        # Each task of a step writes a part for each of the next, so their number is bounded, and a task takes its blocks in turn.
        self.tasks = min(self.count, max(WAVES * context.defaultParallelism, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        key = F.xxhash64(ID)
        if "home" in nodes.columns:
            large = nodes.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("_parts")).where("_parts > 1")
            nodes = nodes.join(F.broadcast(large), "home", "left")
            key = F.xxhash64("home", F.coalesce(F.pmod(key, F.col("_parts")), F.lit(0)))
        nodes = nodes.withColumn("block", F.pmod(key, F.lit(self.count)).cast("int"))
        place = F.row_number().over(Window.partitionBy("block").orderBy(ID)) - 1
        nodes = own.keep(nodes.select(ID, "block", place.alias("at"), "split", "y", "share", "x"))
        end = lambda p: nodes.select(F.col(ID).alias(p), F.col("block").alias(f"{p}_block"), F.col("at").alias(f"{p}_at"))
        ends = edges.join(end("src"), "src").join(end("dst"), "dst").select("src_block", "src_at", "dst_block", "dst_at", "edge_type")

        def pair(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("src_block", kind="stable")
            block, source, target = pdf["src_block"].to_numpy(), pdf["src_at"].to_numpy(), pdf["dst_at"].to_numpy() * relations + pdf["edge_type"].to_numpy()
            begins, rows, here = np.flatnonzero(np.append(True, np.diff(block) != 0)), [], int(pdf["dst_block"].iloc[0])
            for b, e in zip(begins, np.append(begins[1:], len(block)), strict=True):
                (s, s_at), (t, t_at) = (np.unique(v[b:e], return_inverse=True) for v in (source, target))
                if len(t) < len(s) and not sources:
                    n, sent, got = len(t), (t_at, source[b:e]), (np.arange(len(t)), t)
                else:
                    n, sent, got = len(s), (np.arange(len(s)), s), (s_at, target[b:e])
                for at, side, peer, (m, place) in ((block[b], "out", here, sent), (here, "in", block[b], got)):
                    rows.append((at, side, peer, n, m.astype(np.int32).tobytes(), place.astype(np.int32).tobytes()))
            return pd.DataFrame(rows, columns=["block", "side", "peer", "rows", "m", "at"])

        pairs = ends.repartition(self.tasks, "dst_block").groupBy("dst_block").applyInPandas(pair, "block int, side string, peer int, rows int, m binary, at binary")

        def pack(nodes: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
            if not len(nodes):
                return pd.DataFrame()
            nodes = nodes.sort_values("at")
            of = lambda c, kind: nodes[c].to_numpy(kind).tobytes()
            row = {"block": nodes["block"].iloc[0], "ids": of(ID, np.int64), "y": of("y", np.float64), "share": of("share", np.float64), "split": nodes["split"].tolist(), "x": matrix(nodes["x"], len(nodes["x"].iloc[0])).tobytes()}
            for side in ("out", "in"):
                some = pairs[pairs["side"] == side].sort_values("peer")
                before, m = np.cumsum(some["rows"]) - some["rows"], [np.frombuffer(v, np.int32) for v in some["m"]]
                m = np.concatenate([v + b for v, b in zip(m, before, strict=True)]) if m else np.zeros(0)
                row |= {f"{side}_peer": some["peer"].to_numpy(np.int32).tobytes(), f"{side}_rows": some["rows"].to_numpy(np.int32).tobytes(), f"{side}_m": m.astype(np.int32).tobytes(), f"{side}_at": b"".join(some["at"])}
            return pd.DataFrame([row])

        sides = ", ".join(f"{s}_{c} binary" for s in ("out", "in") for c in ("peer", "rows", "m", "at"))
        packed = nodes.repartition(self.tasks, "block").groupBy("block").cogroup(pairs.repartition(self.tasks, "block").groupBy("block"))
        self.table = own.keep(packed.applyInPandas(pack, f"block int, ids binary, y binary, share binary, split array<string>, x binary, {sides}"))

        def halves(b: Block) -> list[tuple]:
            return b.send("out", np.stack([b.ids >> 32, b.ids & 0xFFFFFFFF], axis=1).astype(np.float64))

        def near(b: Block) -> pd.DataFrame:
            ids = b.came("in", 2).astype(np.int64)
            return pd.DataFrame({"block": [b.block], "near": [(ids[:, 0] << 32 | ids[:, 1]).tobytes()]})

        def inputs(b: Block) -> list[tuple]:
            return b.send("out", np.concatenate([b.x, np.ones((b.n, 1))], axis=1))

        def means(b: Block) -> pd.DataFrame:
            sums = b.take("in", b.n * relations, b.x.shape[1] + 1)
            degree = np.maximum(sums[:, -1:], 1.0)
            return pd.DataFrame({"block": [b.block], "m0": [(sums[:, :-1] / degree).tobytes()], "degree": [degree.tobytes()]})

        first = own.keep(self.then(self.begin(halves), near, "block int, near binary") if sources else self.then(self.begin(inputs), means, "block int, m0 binary, degree binary"))
        # In buckets as mail is dealt out, so that no step deals out the table.
        self.table = own.keep_buckets(self.table.join(first, "block").repartition(self.tasks, "block"), self.tasks, "block")
        self.placed = True

    def _rows(self, split: bool = False) -> DataFrame:
        rows = self.table if split else self.table.drop("split")
        return (rows if self.placed else rows.repartition(self.tasks, "block")).groupBy("block")

    def begin(self, step: Callable[[Block], list[tuple]]) -> DataFrame:
        """The mail of a first step."""
        return self._rows().applyInPandas(lambda row: _mail(step(Block(row, None))), MAIL)

    def then(self, mail: DataFrame, step: Callable[[Block], list[tuple] | pd.DataFrame], schema: str = MAIL) -> DataFrame:
        """What ``step`` makes of each block with the mail it got: mail, or rows of ``schema``."""

        def of(mail: pd.DataFrame, row: pd.DataFrame) -> pd.DataFrame:
            out = step(Block(row, mail))
            return out if isinstance(out, pd.DataFrame) else _mail(out)

        return mail.repartition(self.tasks, "to").groupBy("to").cogroup(self._rows("split" in schema)).applyInPandas(of, schema)


def _mail(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["to", "sender", "name", "payload"])


class RelationNetwork(_Network):
    """Layers of one linear map a relation over its in-neighbours' mean, beside a dense branch on own columns.

    Relations weigh equally, or by a softmax of learned logits (``learned_mix``). Hidden units and, in training, whole
    relations are dropped. Relations without any edge take no part.
    """

    def __init__(self, inputs: int, relations: int = 3, hidden: int = 16, layers: int = 2, dropout: float = 0.3, relation_dropout: float = 0.1, learned_mix: bool = False, own_branch: bool = True) -> None:
        self.inputs, self.relations, self.hidden, self.layers = inputs, relations, hidden, layers
        self.dropout, self.relation_dropout, self.learned_mix, self.own_branch = dropout, relation_dropout, learned_mix, own_branch

    def initial(self, seed: int) -> Weights:
        rng, h, w = np.random.default_rng(seed), self.hidden, {}
        if self.own_branch:
            w |= {"own1": glorot(rng, self.inputs, h), "own1b": np.zeros(h), "own2": glorot(rng, h, h), "own2b": np.zeros(h)}
        for l in range(self.layers):
            d = h if l else self.inputs
            w |= {f"self{l}": glorot(rng, d, h), f"bias{l}": np.zeros(h)}
            w |= {f"rel{l}": np.stack([glorot(rng, d, h) for _ in range(self.relations)]), f"relb{l}": np.zeros((self.relations, h))}
            if self.learned_mix:
                w[f"mix{l}"] = np.zeros(self.relations)
        return w | {"out": glorot(rng, h * (1 + self.own_branch), 2), "outb": np.zeros(2)}

    def prepare(self, nodes: DataFrame, edges: DataFrame) -> None:
        """``nodes``: review_id, split, y, share, x, and home if there is one; ``edges``: src, dst, edge_type. Means of the inputs are taken once."""
        self.own = Workspace(nodes.sparkSession, "graph")
        types = {r[0] for r in edges.select("edge_type").distinct().collect()}
        self.active = np.array([r in types for r in range(self.relations)])
        self.base = Blocks(nodes, edges, self.relations, self.own)

    def draws(self, rng: np.random.Generator | None) -> list[np.ndarray]:
        """For each layer what each relation's part is scaled by before mixing; without ``rng`` nothing is dropped."""
        out = []
        for _ in range(self.layers):
            keep, scale = self.active.copy(), 1.0
            if rng is not None and self.relation_dropout > 0 and keep.any():
                keep &= rng.random(self.relations) >= self.relation_dropout
                if not keep.any():
                    keep[rng.choice(np.flatnonzero(self.active))] = True
                scale = 1 / (1 - self.relation_dropout)
            out.append(keep * scale)
        return out

    def _mix(self, w: Weights, l: int, draw: np.ndarray) -> np.ndarray:
        on = draw > 0
        if not on.any():
            return np.zeros(self.relations)
        if self.learned_mix:
            return softmax(np.where(on, w[f"mix{l}"], -np.inf)) * draw
        return draw / on.sum()

    def _layer(self, w: Weights, l: int, h: np.ndarray, m: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum before the rectifier, each relation's own part)."""
        m = m.reshape(len(h), self.relations, -1)
        parts = np.einsum("nrd,rdh->nrh", m, w[f"rel{l}"]) + w[f"relb{l}"]
        return h @ w[f"self{l}"] + w[f"bias{l}"] + np.einsum("r,nrh->nh", self._mix(w, l, draw), parts), parts

    def _layer_back(self, w: Weights, l: int, h: np.ndarray, m: np.ndarray, parts: np.ndarray, draw: np.ndarray, dz: np.ndarray, sums: Sums) -> tuple[np.ndarray, np.ndarray]:
        """Adds the layer's gradients to ``sums`` and gives the adjoints of h and of the means."""
        m, mix = m.reshape(len(h), self.relations, -1), self._mix(w, l, draw)
        sums.add(**{f"self{l}": h.T @ dz, f"bias{l}": dz.sum(0), f"rel{l}": mix[:, None, None] * np.einsum("nrd,nh->rdh", m, dz), f"relb{l}": mix[:, None] * dz.sum(0)})
        if self.learned_mix and (draw > 0).any():
            soft = softmax(np.where(draw > 0, w[f"mix{l}"], -np.inf))
            d = np.einsum("nh,nrh->r", dz, parts) * draw
            sums.add(**{f"mix{l}": soft * (d - (soft * d).sum())})
        return dz @ w[f"self{l}"].T, (mix[None, :, None] * np.einsum("nh,rdh->nrd", dz, w[f"rel{l}"])).reshape(len(h), -1)

    def _raised(self, w: Weights, draws: list[np.ndarray], salt: int | None, b: Block, means: list[np.ndarray]) -> list[np.ndarray]:
        """A block's input of every layer whose means over neighbours are there, and of the one above."""
        h = [b.x]
        for l, m in enumerate(means):
            z, _ = self._layer(w, l, h[-1], m, draws[l])
            h.append(np.maximum(z, 0) * self._kept(b.ids, salt, l + 1))
        return h

    def _means(self, b: Block, l: int) -> tuple[list[np.ndarray], Weights]:
        """(means of the layers up to the l-th, what else was carried): those below came along, the l-th is made of the mail."""
        kept = b.carried() if l else {}
        means = [b.m0.reshape(b.n, -1)] + [kept.pop(f"m{i}").reshape(b.n, -1) for i in range(1, l)]
        if l:
            means.append((b.take("in", b.n * self.relations, self.hidden) / b.degree[:, None]).reshape(b.n, -1))
        return means, kept

    def _forward(self, w: Weights, draws: list[np.ndarray], salt: int | None) -> DataFrame | None:
        """Mail that the last layer waits for: one step along the edges for each layer but the first, whose means are known."""
        mail = None
        for l in range(self.layers - 1):

            def step(b: Block, l: int = l) -> list[tuple]:
                means, _ = self._means(b, l)
                return b.send("out", self._raised(w, draws, salt, b, means)[-1]) + b.carry(**{f"m{i}": means[i] for i in range(1, l + 1)})

            mail = self.base.begin(step) if l == 0 else self.base.then(mail, step)
        return mail

    def _at_last(self, w: Weights, draws: list[np.ndarray], salt: int | None, step: Callable[[Block, list[np.ndarray], np.ndarray], list[tuple] | pd.DataFrame], schema: str = MAIL) -> DataFrame:
        """What ``step`` makes of each block, the means of all layers and the input of the last."""

        def last(b: Block) -> list[tuple] | pd.DataFrame:
            means, _ = self._means(b, self.layers - 1)
            return step(b, means, self._raised(w, draws, salt, b, means[:-1])[-1])

        mail = self._forward(w, draws, salt)
        if mail is None:
            mail = self.base.table.sparkSession.createDataFrame([], MAIL)
        return self.base.then(mail, last, schema)

    def _kept(self, ids: np.ndarray, salt: int | None, place: int) -> np.ndarray:
        return kept(ids, self.hidden, 0 if salt is None else 16 * salt + place, 0.0 if salt is None else self.dropout)

    def _top(self, w: Weights, ids: np.ndarray, x: np.ndarray, h: np.ndarray, m: np.ndarray, draw: np.ndarray, salt: int | None) -> tuple:
        masks = [self._kept(ids, salt, 0), self._kept(ids, salt, self.layers)]
        z, parts = self._layer(w, self.layers - 1, h, m, draw)
        top = np.maximum(z, 0) * masks[1]
        a1 = np.maximum(x @ w["own1"] + w["own1b"], 0) * masks[0] if self.own_branch else None
        a2 = np.maximum(a1 @ w["own2"] + w["own2b"], 0) if self.own_branch else None
        both = np.concatenate([a2, top], axis=1) if self.own_branch else top
        return both @ w["out"] + w["outb"], both, a1, a2, z, parts, masks

    def gradients(self, w: Weights, rng: np.random.Generator | None = None, salt: int | None = None) -> tuple[float, Weights]:
        """The loss of the training rows and its gradient in every weight, in one job: up along the edges and back along them."""
        draws, last = self.draws(rng), self.layers - 1
        share = 1 - self.dropout if salt is not None else 1.0

        def down(b: Block, l: int, means: list[np.ndarray], dh: np.ndarray, dm: np.ndarray, sums: Sums) -> list[tuple]:
            """Mail to the step below: adjoints of means against the edges; the gradients so far and what it needs again are carried."""
            carried = b.carry(**{f"d {k}": np.ravel(v) for k, v in sums.of.items()})
            if not l:
                return carried
            back = dm.reshape(b.n * self.relations, -1) / b.degree[:, None]
            return b.send("in", back) + carried + b.carry(dh=dh, **{f"m{i}": means[i] for i in range(1, l)})

        def top(b: Block, means: list[np.ndarray], h: np.ndarray) -> list[tuple]:
            sums = Sums()
            logits, both, a1, a2, z, parts, masks = self._top(w, b.ids, b.x, h, means[last], draws[last], salt)
            loss, d = loss_of(logits, b.y, b.share)
            sums.add(loss=np.array([loss]), out=both.T @ d, outb=d.sum(0))
            d = d @ w["out"].T
            if self.own_branch:
                d2 = d[:, : self.hidden] * (a2 > 0)
                d1 = (d2 @ w["own2"].T) * masks[0] * (a1 > 0)
                sums.add(own2=a1.T @ d2, own2b=d2.sum(0), own1=b.x.T @ d1, own1b=d1.sum(0))
                d = d[:, self.hidden :]
            dh, dm = self._layer_back(w, last, h, means[last], parts, draws[last], d * masks[1] * (z > 0), sums)
            return down(b, last, means, dh, dm, sums)

        mail = self._at_last(w, draws, salt, top)
        for l in range(last - 1, -1, -1):

            def back(b: Block, l: int = l) -> list[tuple]:
                kept = b.carried()
                means = [b.m0.reshape(b.n, -1)] + [kept[f"m{i}"].reshape(b.n, -1) for i in range(1, l + 1)]
                sums = Sums()
                sums.add(**{k[2:]: v for k, v in kept.items() if k.startswith("d ")})
                *_, h, up = self._raised(w, draws, salt, b, means)
                _, parts = self._layer(w, l, h, means[l], draws[l])
                dz = (kept["dh"].reshape(b.n, -1) + b.take("out", b.n, self.hidden)) * (up > 0) / share
                dh, dm = self._layer_back(w, l, h, means[l], parts, draws[l], dz, sums)
                return down(b, l, means, dh, dm, sums)

            mail = self.base.then(mail, back)
        return summed_blocks(mail, w)

    def scores(self, w: Weights) -> DataFrame:
        """(review_id, split, y, score): the probability of class 1 with nothing dropped; written once, beside the graph."""
        draws = self.draws(None)

        def predict(b: Block, means: list[np.ndarray], h: np.ndarray) -> pd.DataFrame:
            logits = self._top(w, b.ids, b.x, h, means[-1], draws[-1], None)[0]
            return pd.DataFrame({ID: b.ids, "split": b.split, "y": b.y, "score": softmax(logits)[:, 1]})

        return self.own.keep(self._at_last(w, draws, None, predict, f"{ID} long, split string, y double, score double"))

    def outputs(self, w: Weights) -> DataFrame:
        """(review_id, h): the last relation layer's output with nothing dropped."""
        draws = self.draws(None)

        def raise_(b: Block, means: list[np.ndarray], h: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({ID: b.ids, "h": list(np.maximum(self._layer(w, self.layers - 1, h, means[-1], draws[-1])[0], 0))})

        return self._at_last(w, draws, None, raise_, f"{ID} long, h array<double>")

    def relation_weights(self, w: Weights) -> list[tuple[int, int, float]]:
        """(layer, relation, weight) of the mixture, as it scores."""
        return [(l, r, float(a)) for l, draw in enumerate(self.draws(None)) for r, a in enumerate(self._mix(w, l, draw))]


SLOPE = 0.2


def leaky(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, SLOPE * x)


#: Edges of a block whose ends are put beside each other at once.
MET = 65_536


class AttentionNetwork(_Network):
    """Layers in which a node attends to its in-neighbours and itself, by a softmax of learned scores of both ends.

    Inner layers have ``heads`` heads side by side and an exponential unit; the last has one head and two outputs. A pass is
    a chain of steps over blocks: a block sends the rows of its nodes that others attend to, and gets back one row for each.
    """

    def __init__(self, inputs: int, hidden: int = 16, layers: int = 2, heads: int = 4, dropout: float = 0.3) -> None:
        self.inputs, self.layers, self.dropout = inputs, layers, dropout
        each = max(hidden // heads, 1)
        #: (width of the input, heads, outputs of a head) of each layer.
        self.shapes = [(inputs if l == 0 else each * heads, *((1, 2) if l == layers - 1 else (heads, each))) for l in range(layers)]

    def initial(self, seed: int) -> Weights:
        rng, w = np.random.default_rng(seed), {}
        for l, (d, k, c) in enumerate(self.shapes):
            w |= {f"map{l}": glorot(rng, d, k * c), f"src{l}": glorot(rng, k, c), f"dst{l}": glorot(rng, k, c), f"bias{l}": np.zeros(k * c)}
        return w

    def prepare(self, nodes: DataFrame, edges: DataFrame) -> None:
        """``nodes``: review_id, split, y, share, x, and home if there is one; ``edges``: src, dst."""
        self.own = Workspace(nodes.sparkSession, "graph")
        self.base = Blocks(nodes, edges.where("src <> dst").select("src", "dst", F.lit(0).alias("edge_type")), 1, self.own, sources=True)

    def _mapped(self, w: Weights, l: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mapped inputs and the source's part of scores, as they are sent; the receiver's part)."""
        t = (h @ w[f"map{l}"]).reshape(len(h), *self.shapes[l][1:])
        return np.concatenate([t.reshape(len(h), -1), (t * w[f"src{l}"]).sum(2)], axis=1), (t * w[f"dst{l}"]).sum(2)

    def _ends(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """(sources, receivers) of a block's edges and its nodes' own loops, by receiver; sources count what came and then the block's nodes."""
        _, rows, m, at = b.sides["in"]
        source, target = np.append(m, rows.sum() + np.arange(b.n)).astype(np.int64), np.append(at, np.arange(b.n)).astype(np.int64)
        order = target.argsort(kind="stable")
        return source[order], target[order]

    def _met(self, l: int, b: Block, rows: np.ndarray, to: np.ndarray, salt: int | None) -> Iterator[tuple[np.ndarray, ...]]:
        """(sources, receivers, t, scores before the bend, attention before division, what dropout makes of it) of stretches of edges.

        Scores rise with the source's part, so the largest source part gives a node's largest score.
        """
        _, k, c = self.shapes[l]
        source, target = self._ends(b)
        most = np.full((b.n, k), -np.inf)
        for i in range(0, len(source), MET):
            t = target[i : i + MET]
            begins = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            most[t[begins]] = np.maximum(most[t[begins]], np.maximum.reduceat(rows[source[i : i + MET], k * c :], begins, axis=0))
        most, ids = leaky(most + to), np.append(b.near, b.ids).astype(np.uint64)
        for i in range(0, len(source), MET):
            s, t = source[i : i + MET], target[i : i + MET]
            raw = rows[s, k * c :] + to[t]
            with np.errstate(over="ignore"):
                edge = ids[s] * np.uint64(0xD6E8FEB86659FD93) + b.ids[t].astype(np.uint64)
            yield s, t, rows[s, : k * c].reshape(-1, k, c), raw, np.exp(leaky(raw) - most[t]), self._kept(edge, k, salt, 8 + l)

    def _attended(self, w: Weights, l: int, b: Block, h: np.ndarray, came: np.ndarray, salt: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(each node's attended mean before the bias, the softmax's sum, all rows that were attended to, the receiver's part)."""
        _, k, c = self.shapes[l]
        mine, to = self._mapped(w, l, h)
        rows, sums = np.concatenate([came, mine]), np.zeros((b.n, k + k * c))
        for _, t, v, _, power, keep in self._met(l, b, rows, to, salt):
            sums += added(t, np.concatenate([power, ((power * keep)[:, :, None] * v).reshape(len(t), -1)], axis=1), b.n)
        return (sums[:, k:].reshape(b.n, k, c) / sums[:, :k, None]).reshape(b.n, -1), sums[:, :k], rows, to

    def _bent(self, w: Weights, l: int, b: Block, mean: np.ndarray, salt: int | None) -> np.ndarray:
        """A layer's output through the exponential unit and dropout, the next one's input."""
        z = mean + w[f"bias{l}"]
        return np.where(z > 0, z, np.expm1(np.minimum(z, 0))) * self._kept(b.ids, z.shape[1], salt, l)

    def _kept(self, ids: np.ndarray, width: int, salt: int | None, l: int) -> np.ndarray:
        return kept(ids, width, 0 if salt is None else 16 * salt + l, 0.0 if salt is None else self.dropout)

    def _input(self, w: Weights, l: int, b: Block, carried: Weights, salt: int | None) -> np.ndarray:
        """A layer's input, of the mean below that came along."""
        return self._bent(w, l - 1, b, carried[f"o{l - 1}"].reshape(b.n, -1), salt) if l else b.x

    def _came(self, l: int, b: Block) -> np.ndarray:
        _, k, c = self.shapes[l]
        return b.came("in", k * c + k)

    def _at(self, w: Weights, last: int, salt: int | None, step: Callable, schema: str = MAIL, keep: bool = False) -> DataFrame:
        """What ``step`` makes of each block, (mean, what was carried) of the layer ``last``. With ``keep`` what the layers below
        got comes along too, for the way back."""

        def first(b: Block) -> list[tuple]:
            return b.send("out", self._mapped(w, 0, b.x)[0])

        mail = self.base.begin(first)
        for l in range(last):

            def up(b: Block, l: int = l) -> list[tuple]:
                kept, came = b.carried(), self._came(l, b)
                mean = self._attended(w, l, b, self._input(w, l, b, kept, salt), came, salt)[0]
                sent = b.send("out", self._mapped(w, l + 1, self._bent(w, l, b, mean, salt))[0])
                return sent + b.carry(**(kept if keep else {}), **({f"r{l}": came} if keep else {}), **{f"o{l}": mean})

            mail = self.base.then(mail, up)

        def end(b: Block) -> list[tuple] | pd.DataFrame:
            kept = b.carried()
            return step(b, self._attended(w, last, b, self._input(w, last, b, kept, salt), self._came(last, b), salt)[0], kept)

        return self.base.then(mail, end, schema)

    def gradients(self, w: Weights, rng: np.random.Generator | None = None, salt: int | None = None) -> tuple[float, Weights]:
        """The loss of the training rows and its gradient in every weight, in one job: up along the edges and back along them."""
        last = self.layers - 1

        def down(b: Block, l: int, g: np.ndarray, came: np.ndarray, kept: Weights, sums: Sums) -> list[tuple]:
            """Sends back to sources what the adjoint ``g`` of a layer's output makes of their rows.

            The softmax sends back an edge's share times what it gave, less the mean of that over the node's edges, which is g
            times the attended mean.
            """
            _, k, c = self.shapes[l]
            mean, whole, rows, to = self._attended(w, l, b, self._input(w, l, b, kept, salt), came, salt)
            sums.add(**{f"bias{l}": g.sum(0)})
            g = g.reshape(b.n, k, c)
            less = (g * mean.reshape(b.n, k, c)).sum(2)
            back, dd = np.zeros((len(rows), k * c + k)), np.zeros((b.n, k))
            for s, t, v, raw, power, keep in self._met(l, b, rows, to, salt):
                part = power / whole[t]
                score = part * ((g[t] * v).sum(2) * keep - less[t]) * np.where(raw > 0, 1.0, SLOPE)
                back += added(s, np.concatenate([((part * keep)[:, :, None] * g[t]).reshape(len(t), -1), score], axis=1), len(rows))
                dd += added(t, score, b.n)
            below = {n: v for n, v in kept.items() if n[0] in "ro" and int(n[1:]) < l}
            return b.give_back("in", back[: len(came)]) + b.carry(dd=dd, mine=back[len(came) :], **below, **{f"d {n}": np.ravel(v) for n, v in sums.of.items()})

        def top(b: Block, mean: np.ndarray, kept: Weights) -> list[tuple]:
            sums = Sums()
            loss, d = loss_of(mean + w[f"bias{last}"], b.y, b.share)
            sums.add(loss=np.array([loss]))
            return down(b, last, d, self._came(last, b), kept, sums)

        mail = self._at(w, last, salt, top, keep=True)
        for l in range(last, -1, -1):

            def pull(b: Block, l: int = l) -> list[tuple]:
                kept, (_, k, c), sums = b.carried(), self.shapes[l], Sums()
                sums.add(**{n[2:]: v for n, v in kept.items() if n.startswith("d ")})
                h = self._input(w, l, b, kept, salt)
                t = (h @ w[f"map{l}"]).reshape(b.n, k, c)
                v = b.take("out", b.n, k * c + k) + kept["mine"].reshape(b.n, -1)
                ds, dd = v[:, k * c :], kept["dd"].reshape(b.n, k)
                dt = (v[:, : k * c].reshape(b.n, k, c) + ds[:, :, None] * w[f"src{l}"] + dd[:, :, None] * w[f"dst{l}"]).reshape(b.n, -1)
                sums.add(**{f"map{l}": h.T @ dt, f"src{l}": np.einsum("nk,nkc->kc", ds, t), f"dst{l}": np.einsum("nk,nkc->kc", dd, t)})
                if not l:
                    return b.carry(**{f"d {n}": np.ravel(v) for n, v in sums.of.items()})
                z = kept[f"o{l - 1}"].reshape(b.n, -1) + w[f"bias{l - 1}"]
                g = dt @ w[f"map{l}"].T * np.where(z > 0, 1.0, np.exp(np.minimum(z, 0))) * self._kept(b.ids, z.shape[1], salt, l - 1)
                _, k, c = self.shapes[l - 1]
                return down(b, l - 1, g, kept[f"r{l - 1}"].reshape(-1, k * c + k), kept, sums)

            mail = self.base.then(mail, pull)
        return summed_blocks(mail, w)

    def scores(self, w: Weights) -> DataFrame:
        """(review_id, split, y, score): the probability of class 1 with nothing dropped; written once, beside the graph."""
        last = self.layers - 1

        def predict(b: Block, mean: np.ndarray, kept: Weights) -> pd.DataFrame:
            return pd.DataFrame({ID: b.ids, "split": b.split, "y": b.y, "score": softmax(mean + w[f"bias{last}"])[:, 1]})

        return self.own.keep(self._at(w, last, None, predict, f"{ID} long, split string, y double, score double"))

    def attended(self, w: Weights) -> DataFrame:
        """(review_id, o): the first layer's attended means, heads side by side, before the bias."""
        return self._at(w, 0, None, lambda b, mean, _: pd.DataFrame({ID: b.ids, "o": list(mean)}), f"{ID} long, o array<double>")


def fit(model: RelationNetwork | AttentionNetwork, nodes: DataFrame, edges: DataFrame, epochs: int = 30, patience: int = 8, rate: float = 0.02, decay: float = 1e-4, seed: int = 42, report: Callable[[tuple], None] | None = None) -> tuple[Weights, list[tuple[int, float, float, bool]]]:
    """(weights, log) after full-batch descent on the training rows of ``nodes`` (``with_shares``, and x).

    Each epoch takes one step and then the average precision on validation rows with nothing dropped; after ``patience``
    epochs without a rise it stops. The weights are those of the best epoch. log has (epoch, training loss, validation
    average precision, whether best). The same seed draws the same weights and drops the same units.
    """
    model.prepare(nodes, edges)
    rng = np.random.default_rng(seed)
    weights = model.initial(seed)
    adam, best, top, log, since = Adam(weights, rate, decay), weights, -1.0, [], 0
    for epoch in range(1, epochs + 1):
        loss, g = model.gradients(weights, rng, epoch)
        weights = adam.step(weights, g)
        valid = model.scores(weights).where("split = 'valid'").withColumn("score", F.round("score", 9))
        reached = float(stats.average_precision(valid, "score", "y").first()[0] or 0.0)
        log.append((epoch, loss, reached))
        forget_shuffles(nodes.sparkSession)
        if report:
            report(log[-1])
        if reached > top:
            best, top, since = weights, reached, 0
        else:
            since += 1
        if since >= patience:
            break
    at = max(range(len(log)), key=lambda i: (log[i][2], -i)) if log else -1
    return best, [(*x, i == at) for i, x in enumerate(log)]
