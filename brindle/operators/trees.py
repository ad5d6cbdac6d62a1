"""Decision trees and random forests.

Trees grow from a frontier of nodes. Nodes with more rows than ``local_rows``
are split by Spark: rows are exploded to (node, feature, value), counted, and
prefix sums over the values give every candidate's gain in one window, one job a
level. Smaller nodes are finished in one task each, by ``applyInPandas`` on their
rows only. The nodes of all trees are a small table on the driver.

Numeric columns split by ``x >= value``, others (and integer columns of fewer
than 20 values) by ``x == value``. Of equal gains the later candidate wins, in
order of the features and of the values' first appearance. A missing value
follows the true branch with the share of rows that went there, decided by a
hash of row and node.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.base import Model

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
_INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class Question:
    column: int
    value: Any
    numeric: bool

    def matches(self, x: Any) -> bool:
        return x >= self.value if self.numeric else x == self.value

    def __str__(self) -> str:
        return f"Is col {self.column + 1} {'>=' if self.numeric else '=='} {self.value} ?"


@dataclass
class Node:
    """A split (question, shares and children) or a leaf (prediction and rows)."""

    depth: int
    npoints: int
    question: Question | None = None
    p_true: float = 0.0
    true: Node | None = None
    false: Node | None = None
    prediction: Any = None


def gini_of(counts: np.ndarray) -> np.ndarray:
    n = np.maximum(counts.sum(-1, keepdims=True), 1)
    return 1.0 - ((counts / n) ** 2).sum(-1)


def entropy_of(counts: np.ndarray) -> np.ndarray:
    p = counts / np.maximum(counts.sum(-1, keepdims=True), 1)
    return -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(-1)


def variance_of(moments: np.ndarray) -> np.ndarray:
    """From n, sum and sum of squares."""
    n = np.maximum(moments[..., 0], 1)
    return np.maximum(0.0, moments[..., 2] / n - (moments[..., 1] / n) ** 2)


CRITERIA: dict[str, Callable] = {"gini": gini_of, "entropy": entropy_of, "variance": variance_of}


@dataclass
class Plan:
    """What grows a tree, with nothing open."""

    numeric: list[bool]
    criterion: Any
    classes: list | None  # None: regression
    max_depth: int
    min_gain: float
    min_records: int
    max_features: int
    seed: int

    def impurity(self, stats: np.ndarray) -> np.ndarray:
        return (CRITERIA[self.criterion] if isinstance(self.criterion, str) else self.criterion)(stats)


def _stats(y: np.ndarray, plan: Plan) -> np.ndarray:
    """A row's additive statistics: one-hot of the class, or 1, y, y^2."""
    if plan.classes is None:
        return np.stack([np.ones(len(y)), y, y * y], 1)
    out = np.zeros((len(y), len(plan.classes)))
    out[np.arange(len(y)), y] = 1
    return out


def _features(plan: Plan, tree: int, node: int) -> list[int]:
    d = len(plan.numeric)
    if plan.max_features >= d:
        return list(range(d))
    return np.random.default_rng([plan.seed, tree, node]).choice(d, plan.max_features, replace=False).tolist()


def best_split(x: list[np.ndarray], y: np.ndarray, plan: Plan, features: list[int]) -> tuple[float, Question | None]:
    """The best question on rows in memory."""
    n = len(y)
    rows = _stats(y - y.mean() if plan.classes is None else y, plan)
    whole = rows.sum(0)
    parent = float(plan.impurity(whole[None])[0])
    best, question = 0.0, None
    for d in features:
        col = x[d]
        there = ~pd.isnull(col)
        if not there.any():
            continue
        known, stats = col[there], rows[there]
        codes, values = pd.factorize(known)  # in order of first appearance
        per = np.zeros((len(values), rows.shape[1]))
        np.add.at(per, codes, stats)
        if plan.numeric[d]:
            order = np.argsort(np.asarray(values, float), kind="stable")
            true = np.empty_like(per)
            true[order] = np.cumsum(per[order][::-1], 0)[::-1]
        else:
            true = per
        if not there.all():  # missing rows are dealt by the shares
            size = lambda s: s[..., 0] if plan.classes is None else s.sum(-1)
            share = size(true) / size(stats.sum(0))
            true = true + share[:, None] * rows[~there].sum(0)
        false = whole - true
        nt = true[:, 0] if plan.classes is None else true.sum(1)
        p = nt / n
        gain = parent - p * plan.impurity(true) - (1 - p) * plan.impurity(false)
        gain = np.where((nt > 1e-9) & (nt < n - 1e-9), gain, -np.inf)
        # the last of the greatest, as later candidates win ties
        top = gain.max()
        if top >= best - 1e-12:
            at = int(np.flatnonzero(gain >= top - 1e-12)[-1])
            best, question = max(float(top), best), Question(d, values[at].item() if hasattr(values[at], "item") else values[at], plan.numeric[d])
    return best, question


def _leaf(y: np.ndarray, plan: Plan, depth: int) -> Node:
    if plan.classes is None:
        return Node(depth, len(y), prediction=float(np.mean(y)) if len(y) else float("nan"))
    counts = Counter(y.tolist())
    return Node(depth, len(y), prediction={plan.classes[k]: c / len(y) for k, c in sorted(counts.items())})


def _side(question: Question, x: np.ndarray, ids: np.ndarray, node: int, plan: Plan) -> np.ndarray:
    """Which rows go to the true branch."""
    there = ~pd.isnull(x)
    out = np.zeros(len(x), bool)
    out[there] = x[there] >= question.value if question.numeric else x[there] == question.value
    share = out.sum() / there.sum() if there.any() else 0.5
    if not there.all():
        draw = np.array([np.random.default_rng([plan.seed, node & 0x7FFFFFFF, int(i) & 0x7FFFFFFF]).random() for i in ids[~there]])
        out[~there] = draw <= share
    return out


def grow(x: list[np.ndarray], y: np.ndarray, ids: np.ndarray, plan: Plan, tree: int = 0, node: int = 1, depth: int = 1) -> Node:
    """A subtree on rows in memory, with a stack of open nodes."""
    root = Node(depth, len(y))
    stack = [(root, np.arange(len(y)), node)]
    while stack:
        here, rows, number = stack.pop()
        ys = y[rows]
        gain, question = (0.0, None) if len(rows) <= plan.min_records or here.depth >= plan.max_depth else best_split([c[rows] for c in x], ys, plan, _features(plan, tree, number))
        if question is not None and gain > plan.min_gain:
            side = _side(question, x[question.column][rows], ids[rows], number, plan)
            if side.any() and not side.all():
                here.question, here.p_true = question, float(side.mean())
                here.true, here.false = Node(here.depth + 1, int(side.sum())), Node(here.depth + 1, int((~side).sum()))
                stack += [(here.true, rows[side], (2 * number) % (1 << 62)), (here.false, rows[~side], (2 * number + 1) % (1 << 62))]
                continue
        done = _leaf(ys, plan, here.depth)
        here.prediction = done.prediction
    return root


# ---------------------------------------------------------------- growing in Spark


def split_candidates(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], numeric: Sequence[bool], label: str, classes: list | None, allowed: DataFrame | None = None) -> DataFrame:
    """Every candidate split of every node with its side's statistics, by prefix sums over the values.

    t are the statistics of the true side, k those of all rows that know the feature. Partial sums by
    (node, feature, value) go over the shuffle; both windows run over distinct values, in one sort."""
    keys = list(keys)
    stats = [F.count_if(F.col(label) == k).cast("double").alias(f"s{k}") for k in range(len(classes))] if classes is not None else [F.count(F.lit(1)).cast("double").alias("s0"), F.sum(label).alias("s1"), F.sum(F.col(label) * F.col(label)).alias("s2")]
    names = [f"s{i}" for i in range(len(stats))]
    cells = F.array(*[F.struct(F.lit(i).alias("f"), (F.col(c).cast("double") if num else F.lit(None).cast("double")).alias("v"), (F.lit(None).cast("string") if num else F.col(c).cast("string")).alias("c")) for i, (c, num) in enumerate(zip(columns, numeric, strict=True))])
    cells = F.filter(cells, lambda e: e["v"].isNotNull() | e["c"].isNotNull())
    each = rows.select(*keys, "_id", label, F.inline(cells))
    if allowed is not None:
        each = each.join(F.broadcast(allowed), [*keys, "f"])  # max_features rows a node
    per = each.groupBy(*keys, "f", "v", "c").agg(*stats, F.min("_id").alias("first"))
    up = Window.partitionBy(*keys, "f").orderBy(F.desc_nulls_last("v")).rowsBetween(Window.unboundedPreceding, 0)
    known = Window.partitionBy(*keys, "f")
    true = [F.when(F.col("v").isNotNull(), F.sum(s).over(up)).otherwise(F.col(s)).alias(f"t{s[1:]}") for s in names]
    return per.select(*keys, "f", "v", "c", "first", *true, *[F.sum(s).over(known).alias(f"k{s[1:]}") for s in names])


def best_splits(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], numeric: Sequence[bool], label: str, criterion: str | Callable, classes: list | None, allowed: DataFrame | None = None) -> DataFrame:
    """The best split of each node: gain, feature, value (v or c), rows of the true side and their share.

    Rows that miss the feature are dealt to both sides by the shares of those that know it."""
    keys = list(keys)
    got = split_candidates(rows, keys, columns, numeric, label, classes, allowed)
    m = len(classes) if classes is not None else 3
    if classes is not None:
        totals = rows.groupBy(*keys).agg(*[F.count_if(F.col(label) == k).cast("double").alias(f"a{k}") for k in range(m)])
    else:
        totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("a0"), F.sum(label).alias("a1"), F.sum(F.col(label) * F.col(label)).alias("a2"))
    got = got.join(totals, keys) if keys else got.join(F.broadcast(totals))  # one row
    impurity = _impurity_column(criterion, classes is not None)
    size = (lambda xs: sum(xs[1:], xs[0])) if classes is not None else (lambda xs: xs[0])
    there, known, whole = ([F.col(f"{s}{i}") for i in range(m)] for s in "tka")
    n, share = size(whole), size(there) / size(known)
    gaps = n > size(known)  # without any, sums of another order must not leave a remainder
    true = [t + F.when(gaps, share * (a - k)).otherwise(0.0) for t, k, a in zip(there, known, whole, strict=True)]
    false = [a - t for a, t in zip(whole, true, strict=True)]
    nt = size(true)
    gain = impurity(whole) - nt / n * impurity(true) - (1 - nt / n) * impurity(false)
    scored = got.where((nt > 1e-9) & (nt < n - 1e-9)).withColumn("gain", F.round(gain, 12))
    pick = F.max_by(F.struct("gain", "f", "v", "c", nt.alias("n_true"), n.alias("n"), share.alias("p_true")), F.struct("gain", "f", "first", F.coalesce("v", F.lit(0.0)))).alias("b")
    return scored.groupBy(*keys).agg(pick).select(*keys, "b.*")


def _impurity_column(criterion: str | Callable, classification: bool) -> Callable[[list[Column]], Column]:
    """Impurity of a node's statistics; a function of your own sees them in Arrow batches, a row a candidate."""
    if not isinstance(criterion, str):

        def own(stats: pd.Series) -> pd.Series:
            return pd.Series(np.asarray(criterion(np.stack(stats.to_list())), float) if len(stats) else [], dtype=float)

        udf = F.pandas_udf(own, "double")
        return lambda s: udf(F.array(*s))

    def f(s: list[Column]) -> Column:
        if not classification:
            n = F.greatest(s[0], F.lit(1.0))
            return F.greatest(F.lit(0.0), s[2] / n - (s[1] / n) * (s[1] / n))
        n = F.greatest(sum(s[1:], s[0]), F.lit(1.0))
        if criterion == "entropy":
            terms = [F.when(x > 0, -(x / n) * F.log2(F.when(x > 0, x / n))).otherwise(0.0) for x in s]
            return sum(terms[1:], terms[0])
        terms = [(x / n) * (x / n) for x in s]
        return 1.0 - sum(terms[1:], terms[0])

    return f


def build(rows: DataFrame, columns: list[str], plan: Plan, trees: list[int], local_rows: int) -> dict[int, Node]:
    """Grow all trees; ``rows`` has _tree, _id, the columns and _y."""
    roots: dict[int, Node] = {}
    places: dict[tuple[int, int], Node] = {}
    now = rows.withColumn("_node", F.lit(1).cast("long"))
    one = (F.min("_y") == F.max("_y")).alias("one")
    met = now.groupBy("_tree", "_node").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("y"), one).collect()
    pure = {(r["_tree"], r["_node"]) for r in met if r["one"]}
    sizes = {(r["_tree"], r["_node"]): r["n"] for r in met}
    centre = float(np.mean([r["y"] for r in met])) if met else 0.0  # squares of labels far from 0 lose digits
    for t in trees:
        roots[t] = places[t, 1] = Node(1, sizes.get((t, 1), 0))
    local: list[DataFrame] = []
    levels: list[DataFrame] = []  # each level's rows are kept until the leaves below it are grown
    before, needed = None, False  # the level that ``now`` is made from, and whether leaves are grown from it
    while sizes:
        large = {k for k, n in sizes.items() if n > local_rows}
        keep = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).cast("long").alias("n")) for t, k in sorted(large)]) if large else None
        inside = F.array_contains(keep, F.struct(F.col("_tree").alias("t"), F.col("_node").alias("n"))) if large else F.lit(False)
        if len(large) < len(sizes):
            local.append(now.where(~inside) if large else now)
            needed = True
        if not large:
            break
        frontier = now.where(inside)
        # leaves by their depth, or as their rows are of one label, have no candidates to count
        ended = {k for k in large if places[k].depth >= plan.max_depth or (k in pure and plan.min_gain >= 0 and isinstance(plan.criterion, str))}
        unsplit = sorted(large - ended)
        allowed = None
        if plan.max_features < len(columns):
            allowed = now.sparkSession.createDataFrame([(t, k, f) for t, k in unsplit for f in _features(plan, t, k)], "_tree int, _node long, f int")
        got = []
        if unsplit:
            centred = frontier if plan.classes is not None else frontier.withColumn("_y", F.col("_y") - F.lit(centre))
            if ended:
                centred = centred.where(F.array_contains(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).cast("long").alias("n")) for t, k in unsplit]), F.struct(F.col("_tree").alias("t"), F.col("_node").alias("n"))))
            got = best_splits(centred, ["_tree", "_node"], columns, plan.numeric, "_y", plan.criterion, plan.classes, allowed).collect()
        side, next_sizes = None, {}
        split = set()
        for r in got:
            here = places[r["_tree"], r["_node"]]
            if r["gain"] <= plan.min_gain or here.depth >= plan.max_depth:
                continue
            q = Question(r["f"], r["v"] if plan.numeric[r["f"]] else r["c"], plan.numeric[r["f"]])
            split.add((r["_tree"], r["_node"]))
            here.question, here.p_true = q, r["p_true"]
            c = F.col(columns[q.column])
            test = c >= F.lit(q.value) if q.numeric else c.cast("string") == F.lit(str(q.value))
            draw = F.pmod(F.xxhash64("_id", "_node", F.lit(plan.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
            goes = F.when(c.isNull(), draw <= here.p_true).otherwise(test)
            cond = (F.col("_tree") == r["_tree"]) & (F.col("_node") == r["_node"])
            child = F.when(goes, F.lit(2 * r["_node"])).otherwise(F.lit(2 * r["_node"] + 1)).cast("long")
            side = F.when(cond, child) if side is None else side.when(cond, child)
            for k in (0, 1):
                places[r["_tree"], 2 * r["_node"] + k] = Node(here.depth + 1, 0)
            here.true, here.false = places[r["_tree"], 2 * r["_node"]], places[r["_tree"], 2 * r["_node"] + 1]
        stopped = large - split
        if stopped:  # large leaves; by tree and node, as another tree may split the node of the same number
            done = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).cast("long").alias("n")) for t, k in sorted(stopped)])
            _fill_leaves(frontier.where(F.array_contains(done, F.struct(F.col("_tree").alias("t"), F.col("_node").alias("n")))), plan, places)
        if side is None:
            break
        now = frontier.withColumn("_node", side).where("_node is not null").persist()
        levels.append(now)
        for r in now.groupBy("_tree", "_node").agg(F.count(F.lit(1)).alias("n"), one).collect():
            if r["one"]:
                pure.add((r["_tree"], r["_node"]))
            next_sizes[r["_tree"], r["_node"]] = r["n"]
            places[r["_tree"], r["_node"]].npoints = r["n"]
        if before is not None and not needed:
            before.unpersist()
            levels.remove(before)
        before, needed = now, False
        sizes = next_sizes
    depths = {k: v.depth for k, v in places.items()}
    for part in local:
        for r in _grow_local(part, columns, plan, depths, local_rows).collect():
            sub = _unpack(r["nodes"], plan)
            here = places[r["_tree"], r["_node"]]
            here.__dict__.update(sub.__dict__)
    for level in levels:
        level.unpersist()
    return roots


def _fill_leaves(rows: DataFrame, plan: Plan, places: dict[tuple[int, int], Node]) -> None:
    """Predictions of large leaves, from sums (a row a leaf, and a class)."""
    if plan.classes is None:
        for r in rows.groupBy("_tree", "_node").agg(F.avg("_y").alias("y"), F.count(F.lit(1)).alias("n")).collect():
            here = places[r["_tree"], r["_node"]]
            here.prediction, here.npoints = r["y"], r["n"]
        return
    counts: dict[tuple[int, int], dict[int, int]] = {}
    for r in rows.groupBy("_tree", "_node", "_y").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault((r["_tree"], r["_node"]), {})[int(r["_y"])] = r["n"]
    for place, by_class in counts.items():
        n = sum(by_class.values())
        places[place].prediction = {c: by_class[k] / n for k, c in enumerate(plan.classes) if k in by_class}
        places[place].npoints = n


def _grow_local(part: DataFrame, columns: list[str], plan: Plan, depths: dict, local_rows: int) -> DataFrame:
    import pickle

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id", kind="stable")
        tree, node = int(key[0]), int(key[1])
        x = [pdf[c].to_numpy(dtype=float if num else object) for c, num in zip(columns, plan.numeric, strict=True)]
        y = pdf["_y"].to_numpy(dtype=float if plan.classes is None else np.int64)
        # a node that Spark could not split further is a leaf, however many rows it has
        root = grow(x, y, pdf["_id"].to_numpy(), plan, tree, node, depths[tree, node]) if len(pdf) <= local_rows else _leaf(y, plan, depths[tree, node])
        return pd.DataFrame({"_tree": [tree], "_node": [node], "nodes": [pickle.dumps(root)]})

    return part.select("_tree", "_node", "_id", *columns, "_y").groupBy("_tree", "_node").applyInPandas(run, "_tree int, _node long, nodes binary")


def _unpack(blob: bytes, plan: Plan) -> Node:
    import pickle

    return pickle.loads(bytes(blob))


# ---------------------------------------------------------------- scoring


def walk(node: Node, x: Sequence[Any], ignore: frozenset[int] = frozenset(), draw: Callable[[], float] = lambda: 0.5) -> tuple[Any, int]:
    """Prediction and rows behind it; ignored columns follow both branches, weighted by their rows."""
    while node.question is not None:
        q = node.question
        if q.column in ignore:
            (a, n), (b, m) = walk(node.true, x, ignore, draw), walk(node.false, x, ignore, draw)
            return _between(a, n, b, m)
        v = x[q.column]
        if v is None or v != v:
            node = node.true if node.p_true >= draw() else node.false
        else:
            node = node.true if q.matches(v) else node.false
    return node.prediction, node.npoints


def places_of(node: Node, x: Sequence[np.ndarray], rows: np.ndarray, ignore: frozenset[int] = frozenset()) -> tuple[np.ndarray, list[tuple[Any, int]]]:
    """``walk`` for many rows without missing values: a number a row, and what each number means."""
    if node.question is None:
        return np.zeros(len(rows), int), [(node.prediction, node.npoints)]
    q = node.question
    if q.column in ignore:
        (i, a), (j, b) = places_of(node.true, x, rows, ignore), places_of(node.false, x, rows, ignore)
        met, codes = np.unique(i * len(b) + j, return_inverse=True)
        return codes, [_between(*a[m // len(b)], *b[m % len(b)]) for m in met.tolist()]
    v = x[q.column][rows]
    value = float(q.value) if isinstance(q.value, str) and v.dtype.kind in "iuf" else q.value
    side = v >= value if q.numeric else np.asarray(v == value, bool)
    (i, a), (j, b) = places_of(node.true, x, rows[side], ignore), places_of(node.false, x, rows[~side], ignore)
    codes = np.empty(len(rows), int)
    codes[side], codes[~side] = i, j + len(a)
    return codes, a + b


def _between(a: Any, n: int, b: Any, m: int) -> tuple[Any, int]:
    """The mean of two branches, weighted by their rows."""
    if isinstance(a, dict):
        return {k: (a.get(k, 0.0) * n + b.get(k, 0.0) * m) / (n + m) for k in {**a, **b}}, n + m
    return (a * n + b * m) / (n + m), n + m


def as_column(node: Node, columns: Sequence[str], kind: str) -> Column:
    """A small tree as one conditional expression, for data without missing values."""
    if node.question is None:
        if kind == "map":
            return F.create_map(*[x for k, v in node.prediction.items() for x in (F.lit(k), F.lit(v))])
        return F.lit(node.prediction)
    c, q = F.col(columns[node.question.column]), node.question
    test = c >= F.lit(q.value) if q.numeric else c == F.lit(q.value)
    return F.when(test, as_column(node.true, columns, kind)).otherwise(as_column(node.false, columns, kind))


def leaves(node: Node) -> list[Node]:
    return [node] if node.question is None else leaves(node.true) + leaves(node.false)


@dataclass
class TreeView:
    """A node as other tree tools walk it: its children, its value and, on request, the nodes below it in preorder."""

    node: Node
    names: Sequence[str] | None = None
    classes: Sequence[Any] | None = None

    def children(self) -> list[TreeView]:
        """The true and the false branch, or none of a leaf."""
        return [] if self.node.question is None else [TreeView(n, self.names, self.classes) for n in (self.node.true, self.node.false)]

    def value(self) -> str:
        q = self.node.question
        if q is None:
            p = self.node.prediction
            if isinstance(p, dict) and self.classes:
                p = {k: p[k] for k in self.classes if k in p}
            return f"{p}"
        return str(q) if self.names is None else f"{self.names[q.column]} {'>=' if q.numeric else '=='} {q.value}?"

    def __iter__(self):
        stack = [self]
        while stack:
            here = stack.pop()
            yield here
            stack += reversed(here.children())


def wrap(node: Node, names: Sequence[str] | None = None, classes: Sequence[Any] | None = None) -> TreeView:
    return TreeView(node, names, classes)


def depths_of(node: Node) -> tuple[float, int]:
    """Mean and greatest depth of the leaves."""
    d = [x.depth for x in leaves(node)]
    return sum(d) / len(d), max(d)


def to_text(node: Node, names: Sequence[str] | None = None, number: str = "1", indent: str = "") -> str:
    if node.question is None:
        return f"{node.prediction} (n={node.npoints})\n"
    q = node.question
    said = str(q) if names is None else f"Is {names[q.column]} {'>=' if q.numeric else '=='} {q.value} ?"
    inner = indent + "    "
    return f"{number}. {said}\n{indent}--> True : {to_text(node.true, names, number + '.1', inner)}{indent}--> False: {to_text(node.false, names, number + '.2', inner)}"


def to_dot(node: Node, names: Sequence[str] | None = None) -> str:
    lines, stack, k = ["digraph tree {"], [(node, 0)], 0
    while stack:
        here, at = stack.pop()
        if here.question is None:
            lines.append(f'  n{at} [shape=box,label="{here.prediction}"];')
            continue
        q = here.question
        lines.append(f'  n{at} [label="{names[q.column] if names else f"col {q.column + 1}"} {">=" if q.numeric else "=="} {q.value}"];')
        for child, said in ((here.true, "true"), (here.false, "false")):
            k += 1
            lines.append(f'  n{at} -> n{k} [label="{said}"];')
            stack.append((child, k))
    return "\n".join([*lines, "}"])


@dataclass
class TreeHyper:
    max_depth: int | None = None
    min_gain: float = 0.0
    min_records: int = 2
    max_features: int | None = None
    force_classification: bool = False
    splitting_criterion: Any = None  # gini, entropy, variance, or a function of statistics (n x classes, or n x (count, sum, squares))
    fast_algorithm: bool = False  # accepted; prefix sums make it needless
    integer_encoded_cols: list[str] | None = None
    local_rows: int = 50_000
    tunemethod: Any = None


@dataclass
class ForestHyper(TreeHyper):
    n_trees: int = 30
    sampling_share: float = 1.0
    beta: float = 0.0
    oob: bool = False


class DecisionTreeEstimator(Model):
    """A regression tree for numeric labels, else a classifier with a map of probabilities a row."""

    Hyper = TreeHyper
    supervised = True
    forest = False

    def _prepare(self, df: DataFrame, columns: list[str], label: str, id_col: str):
        kinds = [df.schema[c].dataType for c in columns]
        whole = [c for c, k in zip(columns, kinds, strict=True) if isinstance(k, _NUMERIC)]
        encoded = self.hpar.integer_encoded_cols
        if encoded is None and whole:
            got = df.agg(*[x for i, c in enumerate(whole) for x in (F.bool_and(F.col(c) == F.floor(c)).alias(f"i{i}"), F.approx_count_distinct(c).alias(f"d{i}"))]).first()
            near = [c for i, c in enumerate(whole) if got[f"i{i}"] and got[f"d{i}"] < 40]
            exact = df.agg(*[F.count_distinct(c) for c in near]).first() if near else []
            encoded = [c for c, n in zip(near, exact, strict=True) if n < 20]
        numeric = [isinstance(k, _NUMERIC) and c not in (encoded or []) for c, k in zip(columns, kinds, strict=True)]
        y = df.schema[label].dataType
        classes = None
        rows = df.select(F.col(id_col).cast("long").alias("_id"), *[F.col(c) if isinstance(k, (T.StringType, *_NUMERIC)) else F.to_json(c).alias(c) for c, k in zip(columns, kinds, strict=True)], F.col(label).alias("_y"))
        if not isinstance(y, _NUMERIC) or self.hpar.force_classification:
            classes = [r[0] for r in rows.where("_y is not null").groupBy("_y").agg(F.min("_id").alias("i")).orderBy("i").select("_y").collect()]
            rows = rows.withColumn("_y", (F.array_position(F.array(*map(F.lit, classes)), F.col("_y")) - 1).cast("int"))
        else:
            rows = rows.withColumn("_y", F.col("_y").cast("double"))
        return rows.where("_y is not null"), numeric, classes

    def _plan(self, numeric: list[bool], classes: list | None, n: int) -> Plan:
        h, d = self.hpar, len(numeric)
        features = h.max_features or (max(1, round(d**0.5)) if self.forest else d)
        return Plan(numeric, h.splitting_criterion or ("gini" if classes is not None else "variance"), classes, h.max_depth or max(n, 1), h.min_gain, h.min_records, features, self.opt.seed)

    def _fit(self, df: DataFrame, columns: Sequence[str], label: str, id_col: str = "_id") -> None:
        columns = list(columns)
        rows, numeric, classes = self._prepare(df, columns, label, id_col)
        rows = rows.persist()
        try:
            n = rows.count()
            plan = self._plan(numeric, classes, n)
            root = build(rows.withColumn("_tree", F.lit(0)), columns, plan, [0], self.hpar.local_rows)[0]
        finally:
            rows.unpersist()
        avg, top = depths_of(root)
        self.par = {"columns": columns, "trees": [root], "weights": [1.0], "regression": classes is None, "classes": classes, "id_col": id_col, "label_type": df.schema[label].dataType}
        self._info = {"job_is_regression": int(classes is None), "fitted_records": n, "xndims": len(columns), "avg_depth": avg, "max_reached_depth": top}

    def _kind(self) -> str:
        return "double" if self.par["regression"] else f"map<{self.par['label_type'].simpleString()},double>"

    def _transform(self, df: DataFrame, ignore_dims: Sequence[str] = ()) -> DataFrame:
        par = self.par
        small = len(par["trees"]) == 1 and not ignore_dims and len(leaves(par["trees"][0])) <= 128 and all(isinstance(df.schema[c].dataType, (T.StringType, *_NUMERIC)) and not df.schema[c].nullable for c in par["columns"])
        if small:  # stays in Catalyst; columns that may be null need draws
            return df.withColumn("prediction", as_column(par["trees"][0], par["columns"], "double" if par["regression"] else "map"))
        held = df.sparkSession.sparkContext.broadcast((par["trees"], par["weights"], self.opt.seed))  # the size of the model
        ignore = frozenset(par["columns"].index(c) for c in ignore_dims)

        def score(*cols: pd.Series) -> pd.Series:
            trees, weights, seed = held.value
            gaps = np.logical_or.reduce([pd.isnull(c).to_numpy() for c in cols]) if len(cols) else np.zeros(0, bool)
            out = np.empty(len(gaps), object)
            whole, x = np.flatnonzero(~gaps), [c.to_numpy() for c in cols]
            if len(whole):  # rows that meet the same leaves have the same prediction
                codes, means = zip(*[places_of(t, x, whole, ignore) for t in trees], strict=True)
                met, at = np.unique(np.stack(codes, 1), axis=0, return_inverse=True)
                values = np.empty(len(met), object)
                for i, row in enumerate(met.tolist()):
                    values[i] = combine([m[k][0] for m, k in zip(means, row, strict=True)], weights)
                out[whole] = values[at.reshape(-1)]
            for i in np.flatnonzero(gaps):
                x_ = [None if v is None or v is pd.NA or v != v else v for v in (c.iloc[i] for c in cols)]
                rng = np.random.default_rng([seed, zlib.crc32(repr(x_).encode())])
                out[i] = combine([walk(t, x_, ignore, rng.random)[0] for t in trees], weights)
            return pd.Series(out, dtype=object if len(out) and isinstance(out[0], dict) else float)

        kinds = [F.col(c) if isinstance(df.schema[c].dataType, (T.StringType, *_NUMERIC)) else F.to_json(c) for c in par["columns"]]
        udf = F.pandas_udf(score, self._kind())
        return df.withColumn("prediction", udf(*kinds))

    def predict_ignoring(self, df: DataFrame, ignore_dims: Sequence[str]) -> DataFrame:
        """Predictions that do not use some of the columns."""
        return self._transform(df, ignore_dims)

    def nodes(self, spark) -> DataFrame:
        """The model as a table of nodes."""
        out = []
        for t, root in enumerate(self.par["trees"]):
            stack = [(root, 1, 0, "")]
            while stack:
                n, k, parent, side = stack.pop()
                q = n.question
                out.append((t, k, parent, side, q.column if q else None, str(q.value) if q else None, q.numeric if q else None, n.depth, n.npoints, n.p_true if q else None, str(n.prediction) if not q else None))
                if q:
                    stack += [(n.true, 2 * k, k, "true"), (n.false, 2 * k + 1, k, "false")]
        return spark.createDataFrame(out, "tree_id int, node_id long, parent long, side string, col int, value string, is_num boolean, depth int, n long, p_true double, prediction string")

    def to_text(self) -> str:
        return "\n".join(to_text(t, self.par["columns"]) for t in self.par["trees"])


def combine(predictions: list[Any], weights: list[float]) -> Any:
    """Weighted mean of numbers or of probability maps."""
    total = sum(weights) or 1.0
    if isinstance(predictions[0], dict):
        out: dict = {}
        for p, w in zip(predictions, weights, strict=True):
            for k, v in p.items():
                out[k] = out.get(k, 0.0) + v * w / total
        return out
    return sum(p * w for p, w in zip(predictions, weights, strict=True)) / total


class RandomForestEstimator(DecisionTreeEstimator):
    """Trees on rows drawn with replacement and features drawn at each node; soft votes."""

    Hyper = ForestHyper
    forest = True

    def _times(self) -> Column:
        """How often a row (_id) is drawn for a tree (_tree): a Poisson draw by their hash, so rows need no numbers and no join."""
        h, share = self.hpar, self.hpar.sampling_share
        cdf, p, total = [], np.exp(-share), 0.0
        for k in range(12):
            total += p
            cdf.append(float(total))
            p *= share / (k + 1)
        u = F.pmod(F.xxhash64("_id", "_tree", F.lit(self.opt.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        return sum(((u >= F.lit(c)).cast("int") for c in cdf[1:]), (u >= F.lit(cdf[0])).cast("int"))

    def _bootstrap(self, rows: DataFrame, n: int) -> DataFrame:
        drawn = rows.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(self.hpar.n_trees - 1)))).withColumn("_times", self._times())
        return drawn.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_copy")

    def _fit(self, df: DataFrame, columns: Sequence[str], label: str, id_col: str = "_id") -> None:
        columns = list(columns)
        rows, numeric, classes = self._prepare(df, columns, label, id_col)
        rows = rows.persist()
        try:
            n = rows.count()
            plan = self._plan(numeric, classes, n)
            drawn = self._bootstrap(rows, n)
            roots = build(drawn, columns, plan, list(range(self.hpar.n_trees)), self.hpar.local_rows)
            trees = [roots[t] for t in range(self.hpar.n_trees) if roots[t].npoints]
            self.par = {"columns": columns, "trees": trees, "weights": [1.0] * len(trees), "regression": classes is None, "classes": classes, "id_col": id_col, "label_type": df.schema[label].dataType}
            self._info = {"job_is_regression": int(classes is None), "fitted_records": n, "xndims": len(columns)}
            if self.hpar.beta > 0 or self.hpar.oob:
                self._out_of_bag(df, drawn, columns, label, id_col)
        finally:
            rows.unpersist()
        d = [depths_of(t) for t in trees]
        self._info |= {"avg_avg_depth": sum(a for a, _ in d) / len(d), "avg_max_reached_depth": sum(b for _, b in d) / len(d)}

    def _out_of_bag(self, df: DataFrame, drawn: DataFrame, columns: list[str], label: str, id_col: str) -> None:
        """Weights and error from the rows that a tree did not see, which are those of no draw: one scoring pass, no join."""
        par, classes, beta = self.par, self.par["classes"], self.hpar.beta
        held = df.sparkSession.sparkContext.broadcast(par["trees"])
        every = df.select(F.col(id_col).cast("long").alias("_id"), *columns, F.col(label).alias("_label"), F.explode(F.sequence(F.lit(0), F.lit(len(par["trees"]) - 1))).alias("_tree"))
        unseen = every.where((self._times() == 0) | F.col("_label").isNull())

        def score(tree: pd.Series, *cols: pd.Series) -> pd.Series:
            gaps, number, x = np.logical_or.reduce([pd.isnull(c).to_numpy() for c in cols]), tree.to_numpy(), [c.to_numpy() for c in cols]
            out = np.empty(len(tree), object)
            for t in np.unique(number):
                rows = np.flatnonzero((number == t) & ~gaps)
                codes, means = places_of(held.value[t], x, rows)
                values = np.empty(len(means), object)
                for k, (p, _) in enumerate(means):
                    values[k] = p
                out[rows] = values[codes]
            for i in np.flatnonzero(gaps):
                out[i] = walk(held.value[number[i]], [None if v is None or v != v else v for v in (c.iloc[i] for c in cols)])[0]
            return pd.Series(out, dtype=float if par["regression"] else object)

        scored = unseen.withColumn("_p", F.pandas_udf(score, self._kind())("_tree", *columns)).persist()
        y = F.col("_label")
        if classes is None:
            each = scored.groupBy("_tree").agg((F.sum(F.abs(y - F.col("_p"))) / F.sum(F.abs(y))).alias("e")).collect()
            weight = {r["_tree"]: float(np.exp(-beta * r["e"])) if r["e"] is not None else 0.0 for r in each}
            whole = scored.groupBy("_id").agg(F.avg("_p").alias("_p"), F.first("_label").alias("_label"))
            error = whole.agg(F.sum(F.abs(y - F.col("_p"))) / F.sum(F.abs(y))).first()[0]
        else:
            from brindle.functions.pmf import accuracy_of_map, mean_of_maps

            each = scored.groupBy("_tree").agg(F.avg(accuracy_of_map("_label", "_p")).alias("a")).collect()
            weight = {r["_tree"]: beta * r["a"] for r in each}
            mean = mean_of_maps(scored, "_p", ["_id"]).join(scored.groupBy("_id").agg(F.first("_label").alias("_label")), "_id")
            error = 1.0 - (mean.agg(F.avg(accuracy_of_map("_label", "pmf"))).first()[0] or 0.0)
        scored.unpersist()
        if beta > 0 and sum(weight.values()) > 0:
            par["weights"] = [weight.get(t, 0.0) for t in range(len(par["trees"]))]
        self._info["oob_error"] = error


