"""Growing decision trees from histograms of binned columns.

A tree is grown by a generator: it asks for the (gradient, weight, count) sums of some nodes' rows by feature and bin, and gets
them from whoever holds the rows (``ensembles``: Spark jobs over partitions, or a task that holds all rows of a small table).
Gradients and weights are integers (fixed point), so sums are exact in float64 in any order: a node's sums are its parent's
less its sibling's, and every way of cutting the table gives the same tree.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Generator
from dataclasses import dataclass, field

import numpy as np

#: Share of the best split's size below which a gain is rounding; cells of a joint histogram of narrow columns.
NO_GAIN, JOINT_CELLS = 1e-11, 512
#: Rows that are counted at a time.
CHUNK = 1 << 13


@dataclass(frozen=True)
class TreeRule:
    """What a family of trees optimises. ``kind``: ``gini`` (class shares), ``newton`` (gradient and Hessian gain) or
    ``residual`` (variance of the residuals, Newton leaves)."""
    kind: str
    trees: int
    depth: int
    min_leaf: int
    balanced: bool
    rate: float = 1.0
    subsample: float = 1.0
    max_leaves: int | None = None
    n_features: int | None = None
    bootstrap: bool = False
    min_weight: float = 0.0

    @property
    def boosted(self) -> bool:
        return self.kind != "gini"


@dataclass
class Layout:
    """Cut values per feature (``x <= cuts[b]`` goes left of bin b) and the coarser bins for trees on feature samples."""
    cuts: list[np.ndarray]
    coarse_bins: int = 32
    start: np.ndarray = field(init=False)
    coarse: np.ndarray = field(init=False)
    fine: np.ndarray = field(init=False)
    joint: list[tuple[list[int], np.ndarray, np.ndarray]] = field(init=False)

    def __post_init__(self):
        sizes = np.array([len(c) + 1 for c in self.cuts])
        self.start = np.r_[0, sizes.cumsum()]
        bins = np.arange(256)
        self.coarse = np.array([np.minimum(bins, s - 1) if s <= self.coarse_bins else np.minimum(bins, s - 1) * self.coarse_bins // s
                                for s in sizes], np.uint8)
        # the last fine bin of each coarse one
        self.fine = np.array([np.searchsorted(c[:s], np.arange(self.coarse_bins), side="right") - 1 for c, s in zip(self.coarse, sizes)])
        self._join(sizes)

    def _join(self, sizes: np.ndarray) -> None:
        """Columns that are counted together, widest first: each group with its columns, the place of their bins, and the 0/1 matrix
        that adds up the cells of the joint histogram to the columns' own bins."""
        groups: list[list[int]] = []
        for j in np.argsort(-sizes, kind="stable").tolist():
            room = next((g for g in groups if sizes[g].prod() * sizes[j] <= JOINT_CELLS), None)
            if room is None:
                groups.append([j])
            else:
                room.append(j)
        self.joint = []
        for g in groups:
            cell, parts = np.arange(sizes[g].prod()), []
            for j in reversed(g):                                   # the last column turns fastest
                parts.insert(0, np.eye(sizes[j])[cell % sizes[j]])
                cell = cell // sizes[j]
            self.joint.append((g, np.concatenate([np.arange(self.start[j], self.start[j + 1]) for j in g]), np.concatenate(parts, axis=1)))

    def joint_columns(self, x: np.ndarray) -> list[np.ndarray]:
        """The cell of each row of the binned matrix in each group's joint histogram."""
        out, sizes = [], np.diff(self.start)
        for g, _, _ in self.joint:
            cell = np.zeros(len(x), np.uint16)
            for j in g:
                cell = cell * np.uint16(sizes[j]) + x[:, j]
            out.append(cell)
        return out

    def coarse_columns(self, x: np.ndarray) -> np.ndarray:
        """The binned matrix in coarse bins, row by row in one array."""
        return np.stack([self.coarse[j][x[:, j]] for j in range(x.shape[1])], axis=1).ravel()

    def bin(self, j: int, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts[j], x, side="left").astype(np.uint8)


class Tree:
    """Node arrays; node 0 is the root, the right child stands behind the left one. ``sums`` is (3, nodes)."""

    def __init__(self):
        self.feature, self.cut = np.full(1, -1, np.int32), np.zeros(1, np.int32)
        self.left, self.gain = np.zeros(1, np.int32), np.zeros(1)
        self.sums, self.heap = np.zeros((3, 1)), np.ones(1, np.int64)

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Split ``nodes``; ``left`` has the left children's sums. Returns the left children."""
        first, m = len(self.feature), len(nodes)
        children = first + 2 * np.arange(m, dtype=np.int32)
        self.feature[nodes], self.cut[nodes], self.left[nodes], self.gain[nodes] = feature, cut, children, gain
        pair = np.empty((3, 2 * m))
        pair[:, 0::2], pair[:, 1::2] = left, self.sums[:, nodes] - left
        self.feature = np.r_[self.feature, np.full(2 * m, -1, np.int32)]
        self.cut, self.left = np.r_[self.cut, np.zeros(2 * m, np.int32)], np.r_[self.left, np.arange(first, first + 2 * m, dtype=np.int32)]
        self.gain, self.sums = np.r_[self.gain, np.zeros(2 * m)], np.c_[self.sums, pair]
        self.heap = np.r_[self.heap, np.repeat(2 * self.heap[nodes], 2) + np.tile([0, 1], m)]
        return children

    def values(self, rate: float) -> np.ndarray:
        g, h = self.sums[:2]
        return rate * np.divide(g, h, out=np.zeros(len(g)), where=h > 0)

    def standing(self) -> np.ndarray:
        """For each node, itself or the leaf that ``prune`` left above it."""
        order = np.argsort(self.heap)
        parent = order[np.searchsorted(self.heap[order], self.heap // 2).clip(max=len(order) - 1)]
        out = np.arange(len(self.feature))
        for n in range(1, len(out)):                                # children stand behind their parents
            if out[parent[n]] != parent[n] or self.feature[parent[n]] < 0:
                out[n] = out[parent[n]]
        return out

    def route(self, x: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
        """Node that each row of the binned matrix reaches; ``node``, where the rows stood when the tree was smaller, is moved on."""
        if node is None:
            return self._from_root(x)
        rows, flat = np.flatnonzero(self.feature[node] >= 0), x.ravel()
        while len(rows):
            at = node[rows]
            to = self.left[at] + (flat[rows * x.shape[1] + self.feature[at]] > self.cut[at])
            node[rows] = to
            rows = rows[self.feature[to] >= 0]
        return node

    def _from_root(self, x: np.ndarray) -> np.ndarray:
        """``route`` of rows that all stand at the root: all move together, and a leaf, which is its own child, keeps its rows."""
        leaf = self.feature < 0
        feature, left = np.where(leaf, 0, self.feature).astype(np.intp), self.left.astype(np.intp)
        cut = np.where(leaf, 255, self.cut).astype(np.uint8)        # no bin is greater
        node, first, flat = np.zeros(len(x), np.intp), np.arange(len(x)) * x.shape[1], x.ravel()
        while True:
            down = left.take(node)
            down += flat.take(feature.take(node) + first) > cut.take(node)
            if (down == node).all():
                return node.astype(np.int32)
            node = down


def best_splits(sums: np.ndarray, start: np.ndarray, rule: TreeRule, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best position, its gain (0: none) and the left sums (3, nodes). ``sums`` is (3, nodes, positions): blocks of bins,
    block k from ``start[k]``; the first of equal gains wins."""
    width = np.diff(start)
    if (width == width[0]).all():
        left = np.cumsum(sums.reshape(*sums.shape[:2], len(width), -1), axis=3).reshape(sums.shape)
    else:
        cum = np.cumsum(sums, axis=2)
        before = np.concatenate([np.zeros((*cum.shape[:2], 1)), cum[:, :, start[1:-1] - 1]], axis=2)
        left = cum - np.repeat(before, width, axis=2)
    total = left[:, :, start[1] - 1]
    right = total[:, :, None] - left
    den = 2 if rule.kind == "residual" else 1
    ok = (left[2] >= rule.min_leaf) & (right[2] >= rule.min_leaf)
    least = max(rule.min_weight * scale, 1e-9)
    ok &= (left[den] >= least) & (right[den] >= least)
    ok[:, start[1:] - 1] = False
    with np.errstate(divide="ignore", invalid="ignore"):
        size = left[0] ** 2 / left[den] + right[0] ** 2 / right[den]
        gain = np.where(ok, size - (total[0] ** 2 / total[den])[:, None], -np.inf)
    rows = np.arange(sums.shape[1])
    best = gain.argmax(axis=1)
    top = gain[rows, best]
    top = np.where(top > NO_GAIN * np.where(np.isfinite(top), size[rows, best], 1.0), top, 0.0)
    return best, top, left[:, rows, best]


def mix(*parts: np.ndarray | int) -> np.ndarray:
    """64-bit hash of integers, elementwise (splitmix64 steps)."""
    z = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            z = (z ^ np.asarray(p).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
    return z


def uniform(*parts: np.ndarray | int) -> np.ndarray:
    return (mix(*parts) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 13)]))


def bootstrap_counts(key: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) draws by row key: the bootstrap of a table of any size."""
    return np.searchsorted(_POISSON, uniform(key, seed, 1), side="right").astype(np.float64)


def sampled_features(heap: np.ndarray, n: int, of: int, seed: int) -> np.ndarray:
    """``n`` distinct features for each node, by hashes of the node's place in its tree."""
    order = mix(heap[:, None], seed, 2, np.arange(of)[None, :])
    return np.sort(np.argsort(order, axis=1, kind="stable")[:, :n], axis=1)


@dataclass
class Request:
    """Sums wanted for ``nodes`` of the unfinished tree ``number``; ``features`` (nodes, n) where only a sample is looked at."""
    number: int
    tree: Tree
    nodes: np.ndarray
    features: np.ndarray | None
    done: list[Tree]


def grow(rule: TreeRule, layout: Layout, number: int, scale: float, done: list[Tree], seed: int) -> Generator[Request, np.ndarray, Tree]:
    """Grow one tree level by level. Without feature sampling only the smaller child of each pair is asked for."""
    tree, k = Tree(), len(layout.cuts)
    level = np.zeros(1, np.int64)

    def ask(nodes: np.ndarray) -> Request:
        sample = None if rule.n_features is None else sampled_features(tree.heap[nodes], rule.n_features, k, seed)
        return Request(number, tree, nodes, sample, done)
    request = ask(level)
    sums = yield request
    start = layout.start if rule.n_features is None else np.arange(rule.n_features + 1) * layout.coarse_bins
    tree.sums[:, 0] = sums[:, 0, :start[1]].sum(axis=1)
    for depth in range(rule.depth):
        at, gain, left = best_splits(sums, start, rule, scale)
        chosen = np.flatnonzero(gain > 0)
        if not len(chosen):
            break
        block = np.searchsorted(start, at[chosen], side="right") - 1
        cut = at[chosen] - start[block]
        if rule.n_features is not None:
            block = request.features[chosen, block]
            cut = layout.fine[block, cut]
        children = tree.split(level[chosen], block, cut, gain[chosen], left[:, chosen])
        count = tree.sums[2]
        if depth + 1 == rule.depth:
            break
        open_ = count >= 2 * rule.min_leaf
        if rule.kind == "gini":                                     # a node of one class is done
            open_ &= (tree.sums[0] > 0) & (tree.sums[0] < tree.sums[1])
        if rule.n_features is not None:
            level = np.sort(np.r_[children, children + 1])
            level = level[open_[level]]
            if not len(level):
                break
            request, sums, left = ask(level), None, None            # many trees of a forest wait: none keeps its last answer
            sums = yield request
            continue
        busy = open_[children] | open_[children + 1]
        if not busy.any():
            break
        children, parents = children[busy], chosen[busy]
        right_small = count[children + 1] < count[children]
        request = ask(children + right_small)
        small = yield request
        both = np.empty((3, 2 * len(children), small.shape[2]))
        large = sums[:, parents] - small
        both[:, 0::2] = np.where(right_small[:, None], large, small)
        both[:, 1::2] = np.where(right_small[:, None], small, large)
        level = np.ravel(np.c_[children, children + 1])
        keep = open_[level]
        level, sums = level[keep], both[:, keep]
    if rule.max_leaves is not None:
        prune(tree, rule.max_leaves)
    return tree


def prune(tree: Tree, leaves: int) -> None:
    """Keep the splits that growth by largest gain would make until there are ``leaves`` leaves."""
    kept, queue = set(), [(-tree.gain[0], 0)] if tree.feature[0] >= 0 else []
    while queue and len(kept) + 1 < leaves:
        node = heapq.heappop(queue)[1]
        kept.add(node)
        for child in (tree.left[node], tree.left[node] + 1):
            if tree.feature[child] >= 0:
                heapq.heappush(queue, (-tree.gain[child], int(child)))
    gone = np.array([n not in kept for n in range(len(tree.feature))])
    tree.feature[gone], tree.gain[gone] = -1, 0.0
    tree.left[gone] = np.flatnonzero(gone)


def boost(rule: TreeRule, layout: Layout, scale: float, seed: int) -> Generator[Request, np.ndarray, list[Tree]]:
    done: list[Tree] = []
    for number in range(rule.trees):
        done.append((yield from grow(rule, layout, number, scale, done, seed)))
    return done


def node_sums(x: np.ndarray, values: np.ndarray, request: Request, layout: Layout, node: np.ndarray | None = None,
              columns: list[np.ndarray] | np.ndarray | None = None) -> np.ndarray:
    """The answer to a request from the rows at hand: binned matrix ``x`` (rows, features) and ``values`` (3, rows). A caller
    that keeps all rows may pass the ``node`` each one reaches and the matrix as ``Layout.joint_columns`` (all features) or
    ``Layout.coarse_columns`` (sampled features)."""
    slot = _slots(request, request.tree.route(x) if node is None else node)
    rows = np.flatnonzero((slot >= 0) & (values[2] > 0))
    slot, m = slot[rows], len(request.nodes)
    plain = bool((values[2][rows] == 1.0).all())                    # plain counts
    if request.features is None:
        if columns is None:
            columns = layout.joint_columns(x)
        pairs = [np.zeros(m * len(margins), np.complex128) for _, _, margins in layout.joint]
        counts = [np.zeros(m * len(margins)) for _, _, margins in layout.joint]
        for a in range(0, len(rows), CHUNK):                        # what a chunk needs stays in the processor's cache
            mine, own = rows[a:a + CHUNK], slot[a:a + CHUNK]
            pair = values[0][mine] + 1j * values[1][mine]           # two sums in one pass
            third = None if plain else values[2][mine]
            for total, count, column in zip(pairs, counts, columns):
                at = own * (len(total) // m)
                at += column[mine]
                np.add.at(total, at, pair)
                count += np.bincount(at, third, len(count))
        out = np.zeros((3, m, layout.start[-1]))
        for (_, place, margins), total, count in zip(layout.joint, pairs, counts):
            sums = np.concatenate([c.reshape(m, -1) for c in (total.real, total.imag, count)])
            out[:, :, place] = (sums @ margins).reshape(3, m, -1)   # whole numbers: exact in any order
        return out
    bins, n = layout.coarse_bins, request.features.shape[1]
    out = np.zeros((3, m, n * bins))
    weights = [values[0][rows], values[1][rows], None if plain else values[2][rows]]
    first, own = rows * x.shape[1], slot * bins
    for k in range(n):
        f = request.features[:, k][slot]
        at = own + (layout.coarse[f, x[rows, f]] if columns is None else columns[first + f])
        for c in range(3):
            out[c, :, k * bins:(k + 1) * bins] = np.bincount(at, weights[c], m * bins).reshape(m, bins)
    return out


def _slots(request: Request, node: np.ndarray) -> np.ndarray:
    """The place in the request of the node that each row stands in, -1 for other nodes."""
    slot = np.full(len(request.tree.feature), -1, np.int64)
    slot[request.nodes] = np.arange(len(request.nodes))
    return slot[node]


class Bag:
    """The rows that one tree of class shares draws, for requests of sampled features; sums equal those of ``node_sums``.

    A row's value is its draws times its class' weight, so a cell's sums follow from three small counts (rows, draws, draws of
    class 1), which share one float64: one pass over the rows instead of three. Rows whose leaf is reached are dropped.
    """

    def __init__(self, x: np.ndarray, coarse: np.ndarray, draws: np.ndarray, positive: np.ndarray, weights: tuple[float, float]):
        rows = np.flatnonzero(draws > 0)
        self.x, self.coarse, self.first, self.weights = x.ravel(), coarse, rows * x.shape[1], weights
        self.draws, self.positive = draws[rows].astype(np.int64), positive[rows].astype(np.int64)
        self.most, self.node = int(self.draws.max(initial=1)), np.zeros(len(rows), np.int32)

    def _bits(self, rows: int) -> tuple[int, int]:
        """Bits of a count of ``rows`` rows, and of their draws."""
        return rows.bit_length(), (rows * self.most).bit_length()

    def _route(self, tree: Tree) -> None:
        """Move rows down the levels that the tree has grown since, without those that stand in a leaf."""
        while True:
            feature = tree.feature[self.node]
            inner = np.flatnonzero(feature >= 0)
            if not len(inner):
                return
            at = self.node[inner]
            self.node[inner] = tree.left[at] + (self.x[self.first[inner] + feature[inner]] > tree.cut[at])

    def sums(self, request: Request, layout: Layout) -> np.ndarray:
        self._route(request.tree)
        slot, m = _slots(request, self.node), len(request.nodes)
        open_ = slot >= 0
        if not open_.all():
            slot, self.node, self.first = slot[open_], self.node[open_], self.first[open_]
            self.draws, self.positive = self.draws[open_], self.positive[open_]
        bins, n = layout.coarse_bins, request.features.shape[1]
        size = np.bincount(slot, minlength=m).max(initial=1)
        whole = sum(self._bits(int(size))[i] for i in (0, 1, 1)) <= 53      # else a chunk's sums fit
        chunk = max(CHUNK, 2 * m * bins) if whole else CHUNK
        rows, draws = self._bits(int(size) if whole else chunk)
        value = (1 + (self.draws << rows) + ((self.draws * self.positive) << (rows + draws))).astype(np.float64)
        light, heavy = (int(w) for w in self.weights)
        out, packed = np.zeros((3, n, m * bins)), np.zeros((n, m * bins))

        def settle() -> None:
            both = packed.astype(np.int64)
            ones = both >> (rows + draws)
            every = (both >> rows) & ((1 << draws) - 1)
            out[0] += heavy * ones
            out[1] += heavy * ones + light * (every - ones)
            out[2] += both & ((1 << rows) - 1)
            packed.fill(0.0)
        for a in range(0, len(slot), chunk):
            part = slice(a, a + chunk)
            own, first, mine = slot[part] * bins, self.first[part], value[part]
            for k in range(n):
                at = request.features[:, k].take(slot[part])
                at += first
                np.add.at(packed[k], own + self.coarse.take(at), mine)
            if not whole:
                settle()
        if whole:
            settle()
        return out.reshape(3, n, m, bins).transpose(0, 2, 1, 3).reshape(3, m, n * bins)


def drive(growing: dict, answer: Callable[[list], list[np.ndarray]], limit: int, cost: Callable[[Request], int]) -> dict:
    """Run generators to their ends. Their requests wait in a queue; a batch of at most ``limit`` bytes of sums (one request at
    least) is answered at a time. Those that were answered most often come first, so the trees of a forest are finished a few at a
    time, and of all others little is held."""
    waiting, finished, answered = {}, {}, dict.fromkeys(growing, 0)

    def step(key, sums):
        try:
            waiting[key] = next(growing[key]) if sums is None else growing[key].send(sums)
        except StopIteration as end:
            finished[key] = end.value
            growing[key] = None
    for key in growing:
        step(key, None)
    while waiting:
        batch, size = [], 0
        for key in sorted(waiting, key=lambda k: -answered[k]):
            size += cost(waiting[key])
            if batch and size > limit:
                break
            batch.append((key, waiting[key]))
        for key, _ in batch:
            del waiting[key]
            answered[key] += 1
        sums = answer(batch)
        for i, (key, _) in enumerate(batch):
            step(key, sums[i])
            sums[i] = None
    return finished
