"""Gradient boosting on histograms: the models of all repeats and folds grow in the same passes.

Values are binned once, at up to `bins` quantiles of all rows; missing values have a bin of their own, and every split learns the side
they go to. In a pass each task adds gradients, Hessians and counts up per (model, node, feature, bin) over the rows that train the
model; Spark brings the sums of a model together and a task picks its best splits, so the driver sees one small row per model and node.
A tree of depth d takes d passes, whatever the number of models.

Up to `rows_alone` rows a task holds the bins of all rows, some 20 bytes each, and grows its share of the models in memory, one
by one: a model is one piece of work then, and a lost executor costs the models of its tasks. Of two children only the smaller is added up;
the sums of the other are what is left of their parent. Beyond that the passes are Spark jobs:

Rows are cut into slices and models into parts, so that few rows with many models keep all cores busy, and a slice adds up
the histograms of each model once. A row of a part carries its raw scores of the part's models. They are written to the shared folder
every `refresh` rounds, so a pass recomputes few trees, lineage stays short, and a lost executor costs one pass. Leaves are shrunk by an L2 term.
Models whose training rows hold one class only are left out. NULL features are missing values; rows are taken as they are, repeats included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintagerisk import params as P
from vintagerisk.models.logit import Model
from vintagerisk.sources.storage import materialise

MAX_BINS = 255  # and one more for missing values, so a bin number fits a byte
LEAST_HESSIAN = 1e-3
SPLITS = "m int, node int, feature int, cut int, missing_left boolean, gl double, hl double, gr double, hr double"


def edges_of(rows: DataFrame, features: list[str], bins: int = MAX_BINS) -> list[np.ndarray]:
    """Upper ends of the bins of each feature: at most bins - 1 numbers a feature reach the driver."""
    points = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.expr(f"nanvl(cast(`{f}` as double), NULL)"), points, 10_000).alias(f) for f in features]).first()
    return [np.unique(np.array(found[f] or [], dtype="float64")) for f in features]


def binned(x: np.ndarray, edges: list[np.ndarray], missing: int) -> np.ndarray:
    """Bin numbers; a value falls in the first bin whose upper end it does not exceed."""
    columns = [np.where(np.isnan(x[:, j]), missing, np.searchsorted(e, x[:, j], side="left")) for j, e in enumerate(edges)]
    return np.column_stack(columns).astype(np.uint8)


@dataclass
class Forest:
    """Complete binary trees of all models: `feature` is -1 where a node does not split; then its rows keep to the left."""

    features: list[str]
    models: list[Model]
    edges: list[np.ndarray]
    bins: int  # also the number of the bin of missing values
    depth: int
    base: np.ndarray
    weights: np.ndarray  # (models, 2): of negatives and positives
    usable: np.ndarray
    feature: np.ndarray = field(default=None)  # (models, rounds, nodes)
    cut: np.ndarray = field(default=None)
    missing_left: np.ndarray = field(default=None)
    leaf: np.ndarray = field(default=None)  # (models, rounds, leaves)

    def grow(self, rounds: int) -> None:
        nodes, m = (1 << self.depth) - 1, len(self.models)
        self.feature, self.cut = np.full((m, rounds, nodes), -1, np.int16), np.zeros((m, rounds, nodes), np.int16)
        self.missing_left, self.leaf = np.zeros((m, rounds, nodes), bool), np.zeros((m, rounds, nodes + 1))

    def node(self, bins: np.ndarray, m: int, t: int, levels: int) -> np.ndarray:
        """Where each row stands after so many levels of a tree; fastest on bins that are stored by column."""
        at = np.zeros(len(bins), np.uint8 if self.depth < 8 else np.uint32)
        for level in range(levels):
            right = np.zeros(len(bins), bool)
            for node in range((1 << level) - 1, (2 << level) - 1):
                right |= self.goes_right(bins, m, t, node) & (at == node)
            at = 2 * at + 1 + right
        return at.astype(np.int64)

    def goes_right(self, bins: np.ndarray, m: int, t: int, node: int) -> np.ndarray:
        f = self.feature[m, t, node]
        if f < 0:
            return np.zeros(len(bins), bool)
        right = bins[:, f] > int(self.cut[m, t, node])
        return right & (bins[:, f] != self.bins) if self.missing_left[m, t, node] else right

    def placed(self, m: int, t: int, node: int, split: tuple, step: float, l2: float) -> list[int]:
        """Enter the split of a node, or the value of its leaves; the children that are still open."""
        f, cut, missing_left, gl, hl, gr, hr = split
        level = (node + 1).bit_length() - 1
        first, width = ((node + 1) << (self.depth - level)) - (1 << self.depth), 1 << (self.depth - level)  # leaves below this node
        if f < 0:
            self.leaf[m, t, first : first + width] = -step * gl / (hl + l2)
            return []
        self.feature[m, t, node], self.cut[m, t, node], self.missing_left[m, t, node] = f, cut, missing_left
        if level + 1 < self.depth:
            return [2 * node + 1, 2 * node + 2]
        self.leaf[m, t, first], self.leaf[m, t, first + 1] = -step * gl / (hl + l2), -step * gr / (hr + l2)
        return []

    def raw(self, bins: np.ndarray, m: int, first: int, last: int) -> np.ndarray:
        total = np.zeros(len(bins))
        for t in range(first, last):
            total += self.leaf[m, t, self.node(bins, m, t, self.depth) - (1 << self.depth) + 1]
        return total


def best_split(hist: np.ndarray, min_leaf: int, l2: float) -> tuple:
    """(feature, cut, missing goes left, left and right gradient and Hessian) of one node's (3, features, bins) sums."""
    total = hist[:, 0].sum(axis=1)
    missing, below = hist[:, :, -1], np.cumsum(hist[:, :, :-1], axis=2)
    left = np.stack([below, below + missing[:, :, None]], axis=3)  # missing right, missing left
    right = total[:, None, None, None] - left
    score = lambda s: s[0] ** 2 / (s[1] + l2)
    gain = score(left) + score(right) - score(total)
    fine = (left[2] >= min_leaf) & (right[2] >= min_leaf) & (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
    gain = np.where(fine, gain, -np.inf)
    # of equal gains the first one, whatever the rounding of the tasks' sums
    f, c, side = np.unravel_index(int(np.argmax(gain >= gain.max() - 1e-9 * max(1.0, gain.max()))), gain.shape)
    if gain[f, c, side] <= 1e-10:
        return -1, 0, False, total[0], total[1], 0.0, 0.0
    return int(f), int(c), bool(side), *left[:2, f, c, side].tolist(), *right[:2, f, c, side].tolist()


def fit_forest(
    held: DataFrame, models: list[Model], features: list[str] = P.FEATURES, rounds: int = P.GBT_ROUNDS, depth: int = P.GBT_DEPTH, step: float = P.GBT_STEP,
    min_leaf: int = P.GBT_MIN_LEAF, l2: float = P.GBT_L2, balanced: bool = True, bins: int = MAX_BINS, refresh: int = 10, rows_per_task: int = 100_000,
    rows_alone: int = 2_500_000,
) -> Forest:
    """held: features, `y` and `hold` (per repeat the fold a row is held out of). Model (repeat, fold) trains on all other rows."""
    edges = edges_of(held, features, bins)
    bins = max(map(len, edges)) + 1  # few distinct values need few
    counts = ", ".join(f"count_if(hold[{r}] <> {f}), count_if(hold[{r}] <> {f} AND y = 1)" for r, f in models)
    n, pos = np.array(held.selectExpr(f"array({counts}) AS c").first().c, dtype="float64").reshape(-1, 2).T
    usable = (pos > 0) & (pos < n)
    ones = np.ones(len(models))
    weights = np.column_stack([n / (2 * np.maximum(n - pos, 1)), n / (2 * np.maximum(pos, 1))]) if balanced else np.column_stack([ones, ones])
    share = np.where(usable, weights[:, 1] * pos / np.maximum(weights[:, 1] * pos + weights[:, 0] * (n - pos), 1), 0.5)
    forest = Forest(features, models, edges, bins, depth, np.log(share / (1 - share)), weights, usable)
    forest.grow(rounds)
    n_rows, cores = held.count(), held.sparkSession.sparkContext.defaultParallelism
    if n_rows <= rows_alone:
        return _grown_alone(held, forest, _layout(n_rows, len(models), cores, rows_alone)[1], step, min_leaf, l2)
    slices, parts = _layout(n_rows, len(models), cores, rows_per_task)
    state = _started(held, forest, slices, parts)
    for t in range(rounds):
        since = t - t % refresh
        if t and since == t:
            state = _advanced(state, forest, parts, t - refresh, t)
        open_nodes = {(m, 0) for m in np.flatnonzero(usable).tolist()}
        for level in range(depth):
            found = _splits(state, forest, slices, parts, since, t, level, open_nodes, min_leaf, l2)
            open_nodes = {(r.m, n) for r in found for n in forest.placed(r.m, t, r.node, r[2:], step, l2)}
    return forest


ALONE = "part int, place long, n int, bins binary, y binary, train binary"
TREES = "m int, feature binary, cut binary, missing_left binary, leaf binary"


def _grown_alone(held: DataFrame, forest: Forest, parts: int, step: float, min_leaf: int, l2: float) -> Forest:
    """The forest with all trees; a task has all rows of the models of its part."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = TaskContext.get().partitionId() << 32
        for pdf in batches:
            if len(pdf) == 0:
                continue
            place += 1
            bins = binned(pdf[forest.features].to_numpy(dtype="float64"), forest.edges, forest.bins).tobytes()
            y, hold = pdf["y"].to_numpy().astype(np.uint8).tobytes(), np.array(pdf["hold"].tolist(), dtype="int64").reshape(len(pdf), -1)
            for part in range(parts):
                train = np.concatenate([np.packbits(hold[:, r] != f) for r, f in (forest.models[m] for m in _own(forest, parts, part))])
                yield pd.DataFrame({"part": [part], "place": [place], "n": [len(pdf)], "bins": [bins], "y": [y], "train": [train.tobytes()]})

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = [r for pdf in batches for r in pdf.itertuples(index=False)]
        if not pieces:
            return
        own = _own(forest, parts, pieces[0].part)
        pieces.sort(key=lambda r: r.place)
        d = len(forest.features)
        bins = np.concatenate([np.frombuffer(r.bins, np.uint8).reshape(-1, d).T for r in pieces], axis=1)
        y = np.concatenate([np.frombuffer(r.y, np.uint8) for r in pieces])
        packed = [np.frombuffer(r.train, np.uint8).reshape(len(own), -1) for r in pieces]
        sizes = [r.n for r in pieces]
        del pieces
        for k, m in enumerate(own.tolist()):
            if not forest.usable[m]:
                continue
            train = np.flatnonzero(np.concatenate([np.unpackbits(p[k], count=n) for p, n in zip(packed, sizes, strict=True)]))
            _grow_model(forest, m, bins[:, train].T, y[train], step, min_leaf, l2)
            trees = (forest.feature[m], forest.cut[m], forest.missing_left[m], forest.leaf[m])
            yield pd.DataFrame({"m": [m]} | {c.split(" ")[0]: [v.tobytes()] for c, v in zip(TREES.split(", ")[1:], trees, strict=True)})

    dealt = held.select("y", "hold", *forest.features).mapInPandas(deal, ALONE).repartitionById(parts, F.col("part"))
    for r in dealt.mapInPandas(grow, TREES).collect():  # models x rounds x nodes numbers
        for name in ("feature", "cut", "missing_left", "leaf"):
            whole = getattr(forest, name)
            whole[r.m] = np.frombuffer(r[name], whole.dtype).reshape(whole.shape[1:])
    return forest


def _grow_model(forest: Forest, m: int, bins: np.ndarray, y: np.ndarray, step: float, min_leaf: int, l2: float) -> None:
    """All trees of one model on its training rows; `bins` is stored by column."""
    d, width = len(forest.features), forest.bins + 1
    columns = [bins[:, j] for j in range(d)]
    weight = forest.weights[m][y]
    raw = np.full(len(y), forest.base[m])

    def summed(at: np.ndarray | None, g: np.ndarray, h: np.ndarray, n: np.ndarray | None) -> np.ndarray:
        hist = np.empty((3, d, width))
        if at is not None:
            g, h = g[at], h[at]
        for j, column in enumerate(columns):
            x = (column if at is None else column[at]).astype(np.intp)
            hist[0, j], hist[1, j] = np.bincount(x, g, width), np.bincount(x, h, width)
            hist[2, j] = np.bincount(x, None, width) if n is None else n[j]
        return hist

    counts = None  # of all training rows: the same in every round
    for t in range(forest.feature.shape[1]):
        p = 1 / (1 + np.exp(-np.clip(raw, -700, 700)))
        g = weight * (p - y)
        h = weight * p * (1 - p)
        hists = {0: summed(None, g, h, counts)}
        counts = hists[0][2]
        place = np.zeros(len(y), np.uint8 if forest.depth < 8 else np.uint32)
        for level in range(forest.depth):
            right, below = np.zeros(len(y), bool), {}
            opened = {node: forest.placed(m, t, node, best_split(hist, min_leaf, l2), step, l2) for node, hist in hists.items()}
            for node in opened:
                right |= forest.goes_right(bins, m, t, node) & (place == node)
            place = 2 * place + 1 + right
            for node, children in opened.items():
                if children:
                    left, other = (np.flatnonzero(place == c) for c in children)
                    small = 0 if len(left) <= len(other) else 1
                    hist = summed((left, other)[small], g, h, None)
                    below[children[small]], below[children[1 - small]] = hist, hists[node] - hist
            hists = dict(sorted(below.items()))
        raw += forest.leaf[m, t][place - ((1 << forest.depth) - 1)]


ROW_MODELS_PER_TASK = 50_000  # below this a task's pass takes less than its start
STATE = "part int, bins binary, y int, train binary, raw binary"


def _layout(rows: int, models: int, cores: int, rows_per_task: int) -> tuple[int, int]:
    """(slices of the rows, parts of the models): slices hold `rows_per_task` rows, parts fill the cores that slices leave idle."""
    slices = max(1, -(-rows // rows_per_task))
    return slices, max(1, min(models, cores // slices, -(-rows * models // (slices * ROW_MODELS_PER_TASK))))


def _own(forest: Forest, parts: int, part: int) -> np.ndarray:
    return np.arange(part, len(forest.models), parts)


def _started(held: DataFrame, forest: Forest, slices: int, parts: int) -> DataFrame:
    """A row for each row and part: bins, outcome, which models of the part it trains, and their first raw scores."""

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            bins = binned(pdf[forest.features].to_numpy(dtype="float64"), forest.edges, forest.bins)
            hold = np.array(pdf["hold"].tolist(), dtype="int64").reshape(len(pdf), -1)
            for part in range(parts):
                own = _own(forest, parts, part)
                train = np.column_stack([hold[:, r] != f for r, f in (forest.models[m] for m in own)])
                raw = forest.base[own].tobytes()
                yield pd.DataFrame({"part": part, "bins": [b.tobytes() for b in bins], "y": pdf["y"], "train": [b.tobytes() for b in train], "raw": raw, "slice": pdf["slice"]})

    numbered = held.select("y", "hold", *forest.features, (F.monotonically_increasing_id() % slices).cast("int").alias("slice"))
    rows = numbered.mapInPandas(start, f"{STATE}, slice int").repartitionById(slices * parts, F.expr(f"part * {slices} + slice"))
    return materialise(rows.drop("slice"))


def _advanced(state: DataFrame, forest: Forest, parts: int, first: int, last: int) -> DataFrame:
    """The state with the trees of rounds first to last added to the raw scores."""

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, bins, y, train, raw in _unpacked(batches, forest, parts):
            for k, m in enumerate(_own(forest, parts, part)):
                if forest.usable[m]:
                    raw[:, k] += forest.raw(bins, m, first, last)
            packed = {name: [row.tobytes() for row in of] for name, of in (("bins", bins), ("train", train), ("raw", raw))}
            yield pd.DataFrame({"part": part, "y": y} | packed)[[c.split(" ")[0] for c in STATE.split(", ")]]

    return materialise(state.mapInPandas(advance, STATE))


def _unpacked(batches: Iterator[pd.DataFrame], forest: Forest, parts: int) -> Iterator[tuple]:
    """(part, bins, y, train, raw) of the rows of each part in a batch."""
    for batch in batches:
        for part, pdf in batch.groupby("part"):
            matrix = lambda name, kind: np.frombuffer(b"".join(pdf[name]), kind).reshape(len(pdf), -1)  # noqa: B023, E731
            yield part, matrix("bins", np.uint8), pdf["y"].to_numpy(), matrix("train", bool), matrix("raw", np.float64).copy()


def _splits(
    state: DataFrame, forest: Forest, slices: int, parts: int, since: int, t: int, level: int, open_nodes: set[tuple[int, int]], min_leaf: int, l2: float
) -> list:
    """Best split of each open node (model, node) of one level."""
    if not open_nodes:
        return []
    d, width = len(forest.features), forest.bins + 1
    nodes: dict[int, list[int]] = {}
    for m, node in sorted(open_nodes):
        nodes.setdefault(m, []).append(node)

    def summed(batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        for part, bins, y, train, raw in _unpacked(batches, forest, parts):
            cell = np.arange(d) * width + bins
            for k, m in enumerate(_own(forest, parts, part).tolist()):
                if m not in nodes:
                    continue
                own = nodes[m]
                if m not in sums:
                    sums[m] = np.zeros((3, len(own) * d * width))
                number = np.full((1 << (level + 1)) - 1, -1)
                number[own] = np.arange(len(own))
                at = np.flatnonzero(train[:, k])
                place = number[forest.node(bins[at], m, t, level)]
                at, place = at[place >= 0], place[place >= 0]
                x = bins[at]
                p = 1 / (1 + np.exp(-np.clip(raw[at, k] + forest.raw(x, m, since, t), -700, 700)))
                w = forest.weights[m][y[at]]
                into = (place[:, None] * (d * width) + cell[at]).ravel()
                for j, v in enumerate((w * (p - y[at]), w * p * (1 - p), None)):
                    sums[m][j] += np.bincount(into, None if v is None else np.repeat(v, d), len(own) * d * width)
        return sums

    def chosen(m: int, hist: np.ndarray) -> pd.DataFrame:
        hist = hist.reshape(3, len(nodes[m]), d, width)
        rows = [(m, node, *best_split(hist[:, k], min_leaf, l2)) for k, node in enumerate(nodes[m])]
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SPLITS.split(", ")])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = summed(batches)
        yield pd.DataFrame({"m": list(sums), "sums": [s.tobytes() for s in sums.values()]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for m, hist in summed(batches).items():
            yield chosen(m, hist)

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return chosen(key[0], sum(np.frombuffer(s, np.float64) for s in pdf["sums"]))

    if slices == 1:  # a task has all rows of its models
        return state.mapInPandas(whole, SPLITS).collect()
    tasks = min(len(nodes), state.sparkSession.sparkContext.defaultParallelism)
    return state.mapInPandas(partial, "m int, sums binary").repartition(tasks, "m").groupBy("m").applyInPandas(choose, SPLITS).collect()


def out_of_fold(rows: DataFrame, forest: Forest, keys: list[str], name: str = "gbt_pd") -> DataFrame:
    """Mean held-out probability per row over the repeats that scored it; NULL if none did."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rounds = forest.feature.shape[1]
        for pdf in batches:
            bins = np.asfortranarray(binned(pdf[forest.features].to_numpy(dtype="float64"), forest.edges, forest.bins))
            hold = np.array(pdf["hold"].tolist(), dtype="int64").reshape(len(pdf), -1)
            total, count = np.zeros(len(pdf)), np.zeros(len(pdf), dtype="int64")
            for m, (repeat, fold) in enumerate(forest.models):
                mine = np.flatnonzero(hold[:, repeat] == fold)
                if forest.usable[m] and len(mine):
                    total[mine] += 1 / (1 + np.exp(-np.clip(forest.base[m] + forest.raw(bins[mine], m, 0, rounds), -700, 700)))
                    count[mine] += 1
            out = pdf[[*keys, "y"]].copy()
            out[name], out["n_models"] = np.where(count > 0, total / np.maximum(count, 1), np.nan), count
            yield out

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in [*keys, "y"]), f"{name} double", "n_models long"])
    scored = rows.select(*keys, "y", "hold", *forest.features).mapInPandas(score, schema)
    return scored.withColumn(name, F.expr(f"CASE WHEN n_models > 0 THEN {name} END"))
