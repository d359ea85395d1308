"""Gradient-boosted trees of many fits, grown side by side over one table of binned rows.

The method is that of Spark's boosted trees (32 bins a feature, squared or logistic loss, a first tree on the labels,
variance gain, rows drawn per tree and features per node), and so are the models that come back. What differs is the
work: rows are binned once, every level of every fit is one pass in which tasks add up counts and residuals per node and
bin, a sibling is its parent less the other child, and the error of every tree on the held rows comes with the pass
that starts the next tree, so no tree is grown twice to find where to stop.

Tasks keep their blocks, predictions and node numbers in Spark's scratch folder of their executor. That is only a
memory of theirs: blocks come again from the table, and predictions from the trees so far, wherever a task finds none.
"""

from __future__ import annotations

import math
import os
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: As in Spark's trees: bins a feature.
MAX_BINS = 32
#: Joint bins of the features that share one code; fewer for deep trees.
CELLS = 2_048
#: Rows of a block, at most and at least.
BLOCK = (4_096, 131_072)
#: Points that stand for the values of a feature where a task saw more.
POINTS = 1_024
MAX_DEPTH = 13
#: Tasks whose sums go straight to the driver; those of more are added up in tasks first.
DIRECT = 64


@dataclass(frozen=True)
class Fit:
    """One model: the places of its features, its settings, and the fold it never sees (``None``: it sees all rows).

    With ``trees`` it has that many; otherwise the rows held for its fold end it.
    """

    columns: tuple[int, ...]
    params: object
    classifier: bool = False
    fold: int | None = None
    trees: int | None = None


@dataclass
class Tree:
    """Splits by level as ``(nodes, columns, bins)``, and per node of the heap (root 1) its rows, sum and gain."""

    levels: list = field(default_factory=list)
    n: dict = field(default_factory=dict)
    total: dict = field(default_factory=dict)
    gain: dict = field(default_factory=dict)

    def values(self) -> np.ndarray:
        out = np.zeros(max(self.n) + 1)
        for i, n in self.n.items():
            out[i] = self.total[i] / n
        return out


# --- bins ------------------------------------------------------------------------------

def compressed(values: np.ndarray, counts: np.ndarray, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values with their counts, at most ``points`` of them: each run's last value stands for the run."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    ends = np.flatnonzero(np.append(values[1:] != values[:-1], True))
    total = np.cumsum(counts)[ends]
    values = values[ends]
    if len(values) > points:
        ends = np.unique(np.append(np.searchsorted(total, np.arange(1, points) * (total[-1] / points)), len(values) - 1))
        total, values = total[ends], values[ends]
    return values, np.diff(total, prepend=0)


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int = MAX_BINS) -> np.ndarray:
    """Middles between neighbouring values: all of them, or those nearest to equal shares of the rows."""
    if len(values) > bins:
        total = np.cumsum(counts)[:-1]
        aims = np.arange(1, bins) * (counts.sum() / bins)
        after = np.clip(np.searchsorted(total, aims), 1, len(total) - 1)
        places = np.unique(np.where(aims - total[after - 1] <= total[after] - aims, after - 1, after))
    else:
        places = np.arange(len(values) - 1)
    return (values[places] + values[places + 1]) / 2


def _summaries(width: int):
    def tasks(batches):
        seen = [(np.zeros(0), np.zeros(0, np.int64)) for _ in range(width)]
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for c in range(width):
                x = batch.column(c).to_numpy(zero_copy_only=False)
                values, counts = np.unique(x, return_counts=True)
                seen[c] = np.append(seen[c][0], values), np.append(seen[c][1], counts)
                if len(seen[c][0]) > 64 * POINTS:
                    seen[c] = compressed(*seen[c], points=16 * POINTS)
        if rows:
            packed = pickle.dumps([compressed(*s) for s in seen])
            yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([packed], pa.binary())], names=["n", "s"])
    return tasks


def feature_bins(table: DataFrame, names: Sequence[str]) -> tuple[int, list[np.ndarray]]:
    """Rows of the table and the thresholds of every column, from all rows: tasks return at most ``POINTS`` values a column."""
    found = table.select(*[F.col(c).cast("double") for c in names]).mapInArrow(_summaries(len(names)), "n long, s binary").collect()
    parts = [pickle.loads(bytes(r["s"])) for r in found]
    merged = [compressed(*(np.concatenate([p[c][i] for p in parts]) for i in (0, 1)), points=1 << 30) if parts
              else (np.zeros(1), np.zeros(1, np.int64)) for c in range(len(names))]
    return sum(r["n"] for r in found), [thresholds(*m) for m in merged]


class Layout:
    """Which code a column is part of: ``bin = code[group] // stride % bins``. Columns of one bin have no place in a code."""

    def __init__(self, cuts: Sequence[np.ndarray], cells: int):
        self.cuts = list(cuts)
        self.bins = [len(c) + 1 for c in cuts]
        self.group, self.stride, self.cells = {}, {}, []
        for c, b in enumerate(self.bins):
            if b == 1:
                continue
            g = next((g for g, size in enumerate(self.cells) if size * b <= cells), None)
            if g is None:
                g = len(self.cells)
                self.cells.append(1)
            self.group[c], self.stride[c] = g, self.cells[g]
            self.cells[g] *= b
        self.members = [[c for c in self.group if self.group[c] == g] for g in range(len(self.cells))]

    def codes(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(self.cells), len(columns[0])), np.uint16)
        for c, g in self.group.items():
            out[g] += (np.searchsorted(self.cuts[c], columns[c], side="left") * self.stride[c]).astype(np.uint16)
        return out

    def marginal(self, joint: np.ndarray, g: int, c: int) -> np.ndarray:
        """Joint counts ``(nodes, cells)`` of a group summed to one of its columns: ``(nodes, bins)``."""
        return joint.reshape(len(joint), -1, self.bins[c], self.stride[c]).sum(axis=(1, 3))


def _encoder(layout: Layout, width: int, folds: int, rows: int):
    """Tasks that turn batches of features, label, key, fold and words of held folds into pickled blocks."""
    def block(parts):
        columns = [np.concatenate(p) for p in zip(*parts)]
        return pickle.dumps({
            "id": uuid.uuid4().hex, "codes": layout.codes(columns[:width]) if layout.cells else np.zeros((0, len(columns[0])), np.uint16),
            "y": columns[width].astype(float), "key": columns[width + 1].astype(np.uint64).astype(np.uint32),
            "fold": columns[width + 2].astype(np.int32), "held": np.stack([c.astype(np.uint8) for c in columns[width + 3:]])}, protocol=5)

    def tasks(batches):
        parts, size = [], 0
        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, rows - size)
                batch = batch.slice(piece.num_rows)
                parts.append([c.to_numpy(zero_copy_only=False) for c in piece.columns])
                size += piece.num_rows
                if size == rows:
                    yield pa.RecordBatch.from_arrays([pa.array([block(parts)], pa.binary())], names=["b"])
                    parts, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([block(parts)], pa.binary())], names=["b"])
    return tasks


# --- tasks -----------------------------------------------------------------------------

class Missing(Exception):
    """A task has no copy of its block."""


class Store:
    """Blocks and states of one table in the scratch folder of an executor.

    A state has its tree and level in its name, so whoever writes it writes the same.
    """

    def __init__(self, name: str):
        local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or tempfile.gettempdir()
        self.folder = os.path.join(local, f"boost-{name}")
        os.makedirs(self.folder, exist_ok=True)

    def add_block(self, name: str, packed: bytes) -> None:
        # under a name of its own first, as two attempts of a task may write the same
        path = os.path.join(self.folder, f"block-{name}")
        with open(f"{path}.{os.getpid()}", "wb") as out:
            out.write(packed)
        os.replace(f"{path}.{os.getpid()}", path)

    def block(self, name: str) -> dict:
        try:
            with open(os.path.join(self.folder, f"block-{name}"), "rb") as source:
                return pickle.loads(source.read())
        except FileNotFoundError:
            raise Missing(name) from None

    def state(self, name: str, kind: type, size: int) -> np.ndarray | None:
        """The values under a name; none where they are not there or not whole."""
        try:
            values = np.fromfile(os.path.join(self.folder, name), kind)
        except FileNotFoundError:
            return None
        return values if len(values) == size else None

    def keep(self, name: str, values: np.ndarray, before: str) -> None:
        """Write a state in place of the one before."""
        values.tofile(os.path.join(self.folder, name))
        self.remove(before)

    def remove(self, name: str) -> None:
        try:
            os.remove(os.path.join(self.folder, name))
        except FileNotFoundError:
            pass

    def forget(self, run: str) -> None:
        """Delete the states of a run that has ended."""
        for name in os.listdir(self.folder):
            if name.startswith((f"p-{run}-", f"n-{run}-")):
                self.remove(name)


def mixed(key: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of 32 bits of the keys, other ones for every salt."""
    h = key ^ np.uint32(salt)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    h ^= h >> np.uint32(16)
    return h


def drawn(key: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """The rows of a tree: every row is in it with the chance ``share``."""
    if share >= 1:
        return np.ones(len(key), bool)
    first = mixed(np.array([tree], np.uint32), (seed * 0x9E3779B1 + 0x7F4A7C15) & 0xFFFFFFFF)[0]
    return mixed(mixed(key, int(first)), 0x5BD1E995) < np.uint32(min(share * 2.0 ** 32, 2.0 ** 32 - 1))


def moved(node: np.ndarray, splits, codes: np.ndarray, layout: Layout) -> np.ndarray:
    """Every row's node after one more level; rows at a leaf stay."""
    nodes, columns, bins = splits
    n = len(node)
    # per split one row of a table that says for every code whether it goes right
    width = max(layout.cells)
    right = np.zeros((len(nodes) + 1, width), np.uint8)
    for i, (c, b) in enumerate(zip(columns, bins), 1):
        g = layout.group[c]
        right[i, :layout.cells[g]] = np.arange(layout.cells[g]) // layout.stride[c] % layout.bins[c] > b
    if len(nodes) == 1 and nodes[0] == 1:
        return np.add(right[1].take(codes[layout.group[columns[0]]].astype(np.intp)), 2, dtype=np.intp)
    size = 1 << int(nodes[-1]).bit_length()              # all nodes down to the level that is split
    to, row, group = np.arange(size), np.zeros(size, np.intp), np.zeros(size, np.intp)
    to[nodes] *= 2
    row[nodes] = np.arange(1, len(nodes) + 1) * width
    group[nodes] = np.array([layout.group[c] for c in columns]) * n
    at = group.take(node)
    at += np.arange(n)
    at = codes.ravel().take(at) + row.take(node)
    return to.take(node) + right.ravel().take(at)


def residuals(y: np.ndarray, p: np.ndarray | None, classifier: bool) -> np.ndarray:
    """What a tree is fitted to: the labels themselves (of -1 and 1) without predictions, else the loss's negative gradient."""
    if classifier:
        y = 2 * y - 1
        return y if p is None else 4 * y / (1 + np.exp(np.minimum(2 * y * p, 700)))
    return y if p is None else 2 * (y - p)


def sums(place: np.ndarray, r: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows and residuals by place."""
    return [np.bincount(place, minlength=size), np.bincount(place, r, size).astype(float, copy=False)]


def losses(y: np.ndarray, p: np.ndarray, classifier: bool) -> float:
    if classifier:
        margin = 2 * (2 * y - 1) * p
        return float(2 * np.sum(np.maximum(-margin, 0) + np.log1p(np.exp(-np.abs(margin)))))
    return float(np.sum((y - p) ** 2))


class Worker:
    """One step of every fit on a block: rows to their nodes, counts and sums of the asked nodes."""

    def __init__(self, layout: Layout, fits: Sequence[Fit], name: str, run: str = ""):
        self.layout, self.fits, self.name, self.run_name = layout, fits, name, run

    def asides(self, block: dict, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
        """Masks of the rows a fit learns from and of those held to end it."""
        if fit.fold is None:
            return np.ones(len(block["y"]), bool), np.zeros(len(block["y"]), bool)
        own = (block["fold"] != fit.fold) & (block["fold"] >= 0)
        held = (block["held"][fit.fold // 8] >> np.uint8(fit.fold % 8) & np.uint8(1)).astype(bool)
        return own & ~held, own & held

    def predictions(self, block: dict, trees) -> np.ndarray:
        out = np.zeros(len(block["y"]))
        for levels, values, weight in trees:
            node = np.ones(len(out), np.intp)
            for splits in levels:
                node = moved(node, splits, block["codes"], self.layout)
            out += weight * values.take(node)
        return out

    def step(self, store: Store, block: dict, ask: dict, history, draws: dict):
        """The loss on the held rows after the trees so far, and ``(counts, sums)`` by asked node and bin."""
        i, tree, level, levels = ask["fit"], ask["tree"], ask["level"], ask["levels"]
        fit, codes, y = self.fits[i], block["codes"], block["y"]
        n = len(y)

        def name(kind, *at):
            return "-".join([kind, self.run_name, block["id"], *map(str, (i, *at))])

        p = store.state(name("p", tree), float, n) if tree else None
        if tree and p is None:
            last, reached = ask["last"], ask["reached"]
            stored = store.state(name("n", tree - 1, reached), np.uint16, n) if last else None
            p = store.state(name("p", tree - 1), float, n) if tree > 1 else None
            if stored is None or tree > 1 and p is None:
                p = self.predictions(block, history.value[i])
            else:
                node = (stored >> 1).astype(np.intp)
                for splits in last[0][reached:]:
                    node = moved(node, splits, codes, self.layout)
                grown = (last[2] * last[1]).take(node)
                p = grown if tree == 1 else p + grown
            store.keep(name("p", tree), p, name("p", tree - 1))
        held = None
        if level == 0 and tree and ask["held"]:
            aside = np.flatnonzero(self.asides(block, fit)[1])
            held = losses(y.take(aside), p.take(aside), fit.classifier), len(aside)
        asked = ask["nodes"]
        if not asked:
            return held, None
        before = name("n", tree, level - 1) if level else name("n", tree - 1, ask["reached"])
        stored = store.state(before, np.uint16, n) if level else None
        if stored is None:
            key = fit.params.seed, tree, fit.params.row_share
            if key not in draws:
                draws[key] = drawn(block["key"], *key)
            chosen = (draws[key] & self.asides(block, fit)[0]).astype(np.uint16)
            node, steps = np.ones(n, np.intp), levels[:level]
        else:
            chosen = stored & np.uint16(1)
            node, steps = (stored >> 1).astype(np.intp), levels[level - 1:level]
        for splits in steps:
            node = moved(node, splits, codes, self.layout)
        # a state has the node and, in its last bit, whether the row is drawn
        node *= 2
        node += chosen
        store.keep(name("n", tree, level), node.astype(np.uint16), before)
        slot = np.full(4 << level, -1, np.intp)              # of asked nodes, for their drawn rows
        slot[np.array(asked) * 2 + 1] = np.arange(len(asked))
        slots = slot.take(node)
        rows = np.flatnonzero(slots >= 0)
        slots = slots.take(rows)
        r = residuals(y.take(rows), p.take(rows) if tree else None, fit.classifier)
        found = []
        for g in ask["groups"]:
            cells = self.layout.cells[g]
            place = slots * cells
            place += codes[g].take(rows)
            found.append(sums(place, r, len(asked) * cells))
        found.append(sums(slots, r, len(asked)))
        return held, found

    def run(self, store: Store, asks: Sequence[dict], history, blocks) -> dict:
        """Sums of a task over its blocks: per fit the held loss and what ``flat`` makes of the counts and sums."""
        out = {}
        for item in blocks:
            block = self.received(store, item)
            draws: dict = {}
            for ask in asks:
                held, found = self.step(store, block, ask, history, draws)
                before = out.get(ask["fit"])
                if before is None:
                    out[ask["fit"]] = [held, found]
                    continue
                if held is not None:
                    before[0] = before[0][0] + held[0], before[0][1] + held[1]
                for pair, more in zip(before[1] or (), found or ()):
                    for a, b in zip(pair, more):
                        a += b
        groups = {ask["fit"]: ask["groups"] for ask in asks}
        return {i: (held, found and self.flat(groups[i], found)) for i, (held, found) in out.items()}

    def flat(self, groups: Sequence[int], found) -> np.ndarray:
        """``(2, nodes, bins)``: counts and sums by node, the bins of the groups' columns one after the other, and those of the node."""
        nodes = len(found[-1][0])
        parts = [[self.layout.marginal(np.asarray(a, float).reshape(nodes, -1), g, c) for g, pair in zip(groups, found)
                  for a in (pair[k],) for c in self.layout.members[g]] + [np.asarray(found[-1][k], float)[:, None]] for k in (0, 1)]
        return np.stack([np.concatenate(p, axis=1) for p in parts])

    def received(self, store: Store, item) -> dict:
        if isinstance(item, str):
            return store.block(item)
        block = pickle.loads(item[1])
        store.add_block(block["id"], item[1])
        return block


def added(a: dict, b: dict) -> dict:
    """Sums of two tasks."""
    out = dict(a)
    for i, (held, found) in b.items():
        if i in out:
            h, f = out[i]
            held = (h[0] + held[0], h[1] + held[1]) if h else held
            found = f + found if f is not None else found
        out[i] = held, found
    return out


# --- the driver's side -------------------------------------------------------------------

class Growth:
    """One fit: what it asks of the next pass and what it makes of the answer."""

    def __init__(self, number: int, fit: Fit, layout: Layout):
        self.number, self.fit, self.layout = number, fit, layout
        p = fit.params
        self.known = [c for c in fit.columns if c in layout.group]
        self.groups = sorted({layout.group[c] for c in self.known})
        # where the bins of its columns are in the answer, and which of them can end the left side
        order = [c for g in self.groups for c in layout.members[g]]
        begins = dict(zip(order, np.cumsum([0, *[layout.bins[c] for c in order]])))
        self.width = max([layout.bins[c] for c in self.known], default=1)
        inside = np.arange(self.width) < np.array([layout.bins[c] for c in self.known], int).reshape(-1, 1)
        self.places = np.where(inside, np.array([begins[c] for c in self.known], int).reshape(-1, 1) + np.arange(self.width), -1)
        self.kept = max(1, min(len(fit.columns), math.ceil(p.feature_share * len(fit.columns))))
        self.budget = fit.trees or p.max_trees
        self.trees: list[Tree] = []
        self.errors: list[float] = []
        self.done = False
        self.best = None
        self.held = fit.trees is None
        self.reached = 0                 # the level of the last pass of the tree before
        self.begin()

    def begin(self) -> None:
        self.tree, self.level, self.tables = Tree(), 0, None
        self.nodes = [1]

    def weight(self, tree: int) -> float:
        return 1.0 if tree == 0 else self.fit.params.step

    def packed(self, number: int):
        tree = self.trees[number]
        return tree.levels, tree.values(), self.weight(number)

    def ask(self) -> dict:
        number = len(self.trees)
        last = self.packed(number - 1) if number and self.level == 0 else None
        return {"fit": self.number, "tree": number, "level": self.level, "levels": self.tree.levels, "nodes": [] if number >= self.budget else self.nodes,
                "groups": self.groups, "held": self.held, "last": last, "reached": self.reached}

    def take(self, held, found, best_tree) -> None:
        """The answer of a pass: the error after the last tree, then the sums of the asked nodes."""
        number, p = len(self.trees), self.fit.params
        if self.level == 0 and number and self.held:
            if held[1]:
                self.errors.append(held[0] / held[1])
                trees, ended = best_tree(self.errors, p.patience)
                if ended or number >= self.budget:
                    self.best, self.done = trees, True
            else:                                      # no row is held: the first budget is kept
                self.held, self.budget = False, min(p.max_trees, p.patience + 1)
                self.done, self.best = number >= self.budget, self.budget
        if self.done:
            return
        if self.level == 0:
            n, total = (float(x) for x in found[:, 0, -1])
            if not n:
                raise ValueError("a tree needs rows to grow on")
            self.tree.n[1], self.tree.total[1] = n, total
        asked = np.where(self.places >= 0, found[:, :, self.places], 0.0)         # (2, nodes, columns, bins)
        if self.level:
            # one child of a split was asked for, the other is the rest
            rest = self.tables[:, [self.above[node // 2] for node in self.nodes]] - asked
            nodes = [x for node in self.nodes for x in (node, node ^ 1)]
            order = np.argsort(nodes)
            self.tables = np.stack([asked, rest], axis=2).reshape(2, -1, *asked.shape[2:])[:, order]
            self.split([nodes[i] for i in order])
        else:
            self.tables = asked
            self.split([1])

    def split(self, nodes: list[int]) -> None:
        """The best split of every node of the level, and the nodes to ask for next."""
        p, tree = self.fit.params, self.tree
        n, total = (np.array([t[node] for node in nodes])[:, None, None] for t in (tree.n, tree.total))
        left, away = np.cumsum(self.tables, axis=3)
        least = max(1, p.min_rows)
        sound = (left >= least) & (n - left >= least)
        if self.kept < len(self.fit.columns):
            allowed = [chosen_features(p.seed, len(self.trees), node, len(self.fit.columns), self.kept) for node in nodes]
            place = [self.fit.columns.index(c) for c in self.known]
            sound &= np.stack(allowed)[:, place, None]
        # the variance gain, from sums around the node's mean
        away -= left * (total / n)
        gain = np.where(sound, away ** 2 / np.where(sound, left * (n - left), 1), 0.0).reshape(len(nodes), -1)
        best = np.argmax(gain, axis=1) if self.known else np.zeros(len(nodes), int)
        found = []
        for k, (node, place) in enumerate(zip(nodes, best)):
            if not self.known or not gain[k, place] > 0:
                continue
            j, b = divmod(int(place), self.width)
            found.append((node, self.known[j], b))
            tree.gain[node] = float(gain[k, place])
            rows, mean = tree.n[node], tree.total[node] / tree.n[node]
            tree.n[2 * node] = float(left[k, j, b])
            tree.total[2 * node] = float(away[k, j, b]) + tree.n[2 * node] * mean
            tree.n[2 * node + 1] = rows - tree.n[2 * node]
            tree.total[2 * node + 1] = tree.total[node] - tree.total[2 * node]
        if found:
            tree.levels.append(tuple(np.array(x) for x in zip(*found)))
        self.above = {node: k for k, node in enumerate(nodes)}
        self.reached = self.level
        self.level += 1
        # none is asked for where neither child can be split again
        self.nodes = [min(2 * node, 2 * node + 1, key=lambda x: (tree.n[x], x)) for node, _, _ in found
                      if max(tree.n[2 * node], tree.n[2 * node + 1]) >= 2 * p.min_rows]
        if self.level >= p.depth or not self.nodes:
            self.trees.append(tree)
            if not self.held and len(self.trees) >= self.budget:
                self.done, self.best = True, self.budget
            else:
                self.begin()


@lru_cache(maxsize=4_096)
def chosen_features(seed: int, tree: int, node: int, width: int, kept: int) -> np.ndarray:
    """A mask of the features a node may split on."""
    out = np.zeros(width, bool)
    out[np.random.default_rng([seed, tree, node]).choice(width, kept, replace=False)] = True
    return out


class Past:
    """The trees of running fits so far, for tasks that have lost their predictions."""

    def __init__(self, growths: Sequence[Growth]):
        self.growths = growths

    @property
    def value(self) -> dict:
        return {g.number: [g.packed(t) for t in range(len(g.trees))] for g in self.growths}


class Rows:
    """The rows of a table, binned and dealt in blocks over all tasks, for any number of fits."""

    def __init__(self, table: DataFrame, names: Sequence[str], label: Column, key: Column | None = None, fold: Column | None = None,
                 held: str | None = None, folds: int = 1, depth: int = 5):
        if depth > MAX_DEPTH:
            raise ValueError(f"trees of more than {MAX_DEPTH} levels")
        context = table.sparkSession.sparkContext
        self.context, self.name, self.names = context, uuid.uuid4().hex, list(names)
        self.count, cuts = feature_bins(table, names)
        self.layout = Layout(cuts, max(MAX_BINS + 1, min(CELLS, (1 << 19) >> depth)))
        tasks = max(1, context.defaultParallelism)
        size = int(min(max(BLOCK[0], math.ceil(self.count / (2 * tasks))), BLOCK[1]))
        bits = [F.expr(f"aggregate(coalesce(`{held}`, array()), 0, (a, j) -> IF(j DIV 8 = {w}, a | shiftleft(1, j - {8 * w}), a))")
                if held else F.lit(0) for w in range((folds + 7) // 8)]
        rows = table.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)], label.cast("double").alias("y"),
                            F.xxhash64(key if key is not None else F.monotonically_increasing_id()).alias("k"),
                            F.coalesce(fold.cast("int") if fold is not None else F.lit(0), F.lit(-1)).alias("f"),
                            *[b.alias(f"h{w}") for w, b in enumerate(bits)])
        blocks = rows.mapInArrow(_encoder(self.layout, len(names), folds, size), "b binary").rdd.map(lambda r: bytes(r[0]))
        n = max(1, min(math.ceil(self.count / size) + 1, tasks))
        # blocks are of one size but for the last of every task, so they are dealt in turn; a block that is read again is the same
        self.blocks = blocks.mapPartitionsWithIndex(lambda i, it: ((i + k, b) for k, b in enumerate(it))).partitionBy(n, lambda k: k)
        worker = Worker(self.layout, (), self.name)

        def kept(items):
            store = Store(worker.name)
            for item in items:
                yield worker.received(store, item)["id"]

        self.keys = self.blocks.mapPartitions(kept).persist(StorageLevel.MEMORY_AND_DISK)

    def grow(self, fits: Sequence[Fit], best_tree) -> list[Growth]:
        """Every fit to its end; ``best_tree(errors, patience)`` says which tree is the best and whether to stop."""
        if not self.count:
            raise ValueError("a tree needs rows to grow on")
        worker = Worker(self.layout, list(fits), self.name, uuid.uuid4().hex)
        growths = [Growth(i, f, self.layout) for i, f in enumerate(fits)]
        try:
            return self.grown(worker, growths, best_tree)
        finally:
            name, run = worker.name, worker.run_name
            self.keys.mapPartitions(lambda _: [Store(name).forget(run)]).collect()

    def grown(self, worker: Worker, growths: list[Growth], best_tree) -> list[Growth]:
        """A job for every pass, of all fits that run. (A barrier stage takes a second for every exchange.)"""
        history, size = None, None
        while any(not g.done for g in growths):
            active = [g for g in growths if not g.done]
            done = [(g.number, len(g.trees)) for g in active]
            if done != size:
                if history is not None:
                    history.destroy()
                history, size = self.context.broadcast(Past(active).value), done
            answer = self.passed(worker, [g.ask() for g in active], history)
            for g in active:
                g.take(*answer[g.number], best_tree)
        if history is not None:
            history.destroy()
        return growths

    def passed(self, worker: Worker, asks, history) -> dict:
        def light(items):
            try:
                yield worker.run(Store(worker.name), asks, history, items)
            except Missing:
                yield None

        def heavy(items):
            yield worker.run(Store(worker.name), asks, history, items)

        found = self.summed(self.keys.mapPartitions(light))
        return found if found is not None else self.summed(self.blocks.mapPartitions(heavy))

    def summed(self, parts):
        def both(a, b):
            return None if a is None or b is None else added(a, b)
        if parts.getNumPartitions() > DIRECT:
            return parts.treeReduce(both)
        return reduce(both, parts.collect())

    def close(self) -> None:
        name = self.name

        def gone(_):
            shutil.rmtree(Store(name).folder, ignore_errors=True)
            yield 0
        self.keys.mapPartitions(gone).collect()
        self.keys.unpersist()


def model(context, estimator, growth: Growth, cuts: Sequence[np.ndarray], classifier: bool):
    """The fit's best trees as a model of Spark's; the impurity of nodes is not kept."""
    ml, tree_kit = context._jvm.org.apache.spark.ml, context._jvm.org.apache.spark.mllib.tree.impurity
    new_array = context._gateway.new_array
    place = {c: i for i, c in enumerate(growth.fit.columns)}
    width = len(growth.fit.columns)

    def stats(tree: Tree, node: int):
        values = new_array(context._jvm.double, 3)
        values[0], values[1], values[2] = tree.n[node], tree.total[node], float("nan")
        return tree_kit.VarianceCalculator(values, int(tree.n[node]))

    def root(tree: Tree):
        splits = {int(i): (int(c), int(b)) for nodes in tree.levels for i, c, b in zip(*nodes)}
        made = {}
        for node in sorted(tree.n, reverse=True):       # children have larger numbers than their parent
            value = float(tree.total[node] / tree.n[node])
            if node not in splits:
                made[node] = ml.tree.LeafNode(value, float("nan"), stats(tree, node))
                continue
            c, b = splits[node]
            split = ml.tree.ContinuousSplit(place[c], float(cuts[c][b]))
            made[node] = ml.tree.InternalNode(value, float("nan"), tree.gain[node], made[2 * node], made[2 * node + 1], split, stats(tree, node))
        return made[1]

    kept = growth.trees[:growth.best]
    trees = new_array(ml.regression.DecisionTreeRegressionModel, len(kept))
    weights = new_array(context._jvm.double, len(kept))
    for i, t in enumerate(kept):
        trees[i] = ml.regression.DecisionTreeRegressionModel(f"dtr_{uuid.uuid4().hex[:12]}", root(t), width)
        weights[i] = growth.weight(i)
    if classifier:
        made = ml.classification.GBTClassificationModel(estimator.uid, trees, weights, width, 2)
    else:
        made = ml.regression.GBTRegressionModel(estimator.uid, trees, weights, width)
    return estimator._copyValues(estimator._create_model(made))
