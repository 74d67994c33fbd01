"""Gradient-boosted regression trees in numpy: many fits at once, NULLs as a branch of their own.

Small helper of the fan-out in ``model.py``: Spark deals out blocks of series, this fits those of a block side
by side. A step grows one tree of every fit: histograms, gains and routes of all fits are single numpy
calls over the block's rows, so the cost of a call is shared by all fits, folds included.
"""

from __future__ import annotations

import ctypes
import io
import json
import zlib
from collections.abc import Sequence

import numpy as np

#: Values of a variable are binned; the last bin is for NULLs.
BINS = 64
#: Trees between two looks at which fits are done, and trees that are applied to rows at once.
LOOK, CHUNK = 64, 256
#: Groups of rows whose splits are searched at once.
GROUPS = 256


def quantile_edges(x: np.ndarray) -> list[np.ndarray]:
    """By column, the borders of its bins."""
    out = []
    for j in range(x.shape[1]):
        v = x[~np.isnan(x[:, j]), j]
        out.append(np.unique(np.quantile(v, np.linspace(0, 1, BINS)[1:-1])) if len(v) else np.zeros(0))
    return out


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.int64)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), BINS, np.searchsorted(e, x[:, j], side="left"))
    return out


def _mixed(z: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit numbers: a row's draws depend on its fit's seed and its place alone."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def best_splits(n: np.ndarray, s: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By group, the best split's gain, variable and bin, from counts and sums by (group, variable, bin). Groups are searched
    ``GROUPS`` at a time, by bin first: sums along the bins add long rows, in arrays that stay in a core's cache."""
    groups, width, slots = n.shape
    best, variable, k = np.full(groups, -np.inf), np.zeros(groups, np.int64), np.zeros(groups, np.int64)
    for first in range(0, groups if width else 0, GROUPS):
        last = min(groups, first + GROUPS)
        part = np.empty((slots, 2, (last - first) * width))
        part[:, 0], part[:, 1] = n[first:last].reshape(-1, slots).T, s[first:last].reshape(-1, slots).T
        n_null, s_null = part[BINS].copy()
        left = part[:BINS]
        before, *rows = left
        for row in rows:
            before = np.add(before, row, row)
        n_all, s_all = before
        total = (s_all + s_null)[::width] ** 2 / np.maximum(1, (n_all + n_null)[::width])
        nl, sl = np.ascontiguousarray(left[:-1, 0]), left[:-1, 1]
        nr, sr = n_all - nl, s_all - sl
        few = nl < max(1, least)
        few |= nr < max(1, least)
        gain = sl * sl
        with np.errstate(divide="ignore", invalid="ignore"):  # sides without rows have too few
            gain /= nl
            sr *= sr
            sr /= nr
        gain += sr
        np.copyto(gain, -np.inf, where=few)
        most = (gain.max(0) + (s_null**2 / np.maximum(n_null, 1) - total.repeat(width))).reshape(-1, width)
        j, every = most.argmax(1), np.arange(last - first)
        best[first:last], variable[first:last], k[first:last] = most[every, j], j, gain.take(every * width + j, 1).argmax(0)
    return best, variable, k


class Lockstep:
    """Squared loss; the trees of all fits grow best-first to ``splits`` splits, each with a left, a right and a
    NULL child. Node 0 is the root, the children of the s-th split are 1 + 3 s and the two after it."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, of: np.ndarray, learns: np.ndarray, seeds: np.ndarray, rate: float, splits: int, bag: float = 0.5, least: int = 10) -> None:
        self.y, self.of, self.learns, self.fits, self.width = y, of, learns, len(seeds), bins.shape[1]
        #: By variable and row, the bin in a byte, and its place in a histogram by (fit, variable, bin).
        self.bins = np.ascontiguousarray(bins.T).astype(np.uint8)
        self.places = self.bins + np.arange(self.width)[:, None] * (BINS + 1) + of * (self.width * (BINS + 1))
        self.rate, self.splits, self.bag, self.least, self.t = rate, splits, bag, least, 0
        n = np.bincount(of[learns], minlength=self.fits)
        self.start = np.bincount(of[learns], y[learns], self.fits) / np.maximum(1, n)
        self.f = self.start[of]
        place = np.arange(len(y)) - np.searchsorted(of, np.arange(self.fits))[of]  # rows of a fit stand together
        self.keys = _mixed(seeds.astype(np.uint64)[of] * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))
        self.drawn = np.zeros((8, len(y)), bool)
        self._placed()

    def _placed(self) -> None:
        """Where the rows of each fit are, and those that it doesn't learn from."""
        self.sizes = np.bincount(self.of, minlength=self.fits)
        self.held = np.flatnonzero(~self.learns)
        self.held_of, self.held_y = self.of[self.held], self.y[self.held]
        self.every = np.arange(len(self.y))
        self.root = self.of * (1 + 3 * self.splits)  # of each row's fit, among the nodes of all fits

    def held_out(self) -> np.ndarray:
        """By fit, the sum of squared errors on the rows that it doesn't learn from."""
        off = self.held_y - self.f.take(self.held)
        off *= off
        return np.bincount(self.held_of, off, self.fits)

    def keep(self, wanted: np.ndarray) -> None:
        """Goes on with some of the fits only; they are numbered anew."""
        rows, number = wanted[self.of], np.cumsum(wanted) - 1
        self.y, self.learns, self.f, self.keys = (a[rows] for a in (self.y, self.learns, self.f, self.keys))
        self.bins, self.places, self.drawn = (np.ascontiguousarray(a[:, rows]) for a in (self.bins, self.places, self.drawn))
        of, self.of = self.of[rows], number[self.of[rows]]
        self.places += (self.of - of) * (self.width * (BINS + 1))
        self.start, self.fits = self.start[wanted], int(wanted.sum())
        self._placed()

    def _bagged(self) -> np.ndarray:
        if self.bag >= 1:
            return self.learns
        if self.t % 8 == 0:  # eight trees' draws at a time, a byte each
            draws = _mixed(self.keys + np.array([self.t // 8 + 1], np.uint64) * np.uint64(0xD1B54A32D192ED03))
            self.drawn = np.ascontiguousarray(draws.astype("<u8").view(np.uint8).reshape(-1, 8).T) < np.uint16(round(256 * self.bag))
            self.drawn &= self.learns
        return self.drawn[self.t % 8]

    def _best(self, at: np.ndarray, groups: int, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By group of rows, the best split's gain, variable and bin, from the rows' places by variable."""
        shape = groups, self.width, BINS + 1
        at, size = at.ravel(), groups * self.width * (BINS + 1)
        n = np.bincount(at, minlength=size).reshape(shape)
        s = np.bincount(at, np.broadcast_to(r, (self.width, len(r))).ravel(), size).reshape(shape)
        return best_splits(n, s, self.least)

    def grow(self) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """One tree of every fit, as arrays by (fit, node); ``f`` moves on. Also the rows that were drawn."""
        fits, nodes, every = self.fits, 1 + 3 * self.splits, np.arange(self.fits)
        tree = {"feature": np.full((fits, nodes), -1, np.int16), "cut": np.zeros((fits, nodes), np.int16), "child": np.full((fits, nodes), -1, np.int16), "value": np.zeros((fits, nodes)), "rows": np.zeros((fits, nodes), np.int32), "gain": np.zeros((fits, nodes))}
        bagged = self._bagged()
        self.t += 1
        rows = np.flatnonzero(bagged)
        of, r, base = self.of.take(rows), self.y.take(rows) - self.f.take(rows), self.places.take(rows, 1)
        tree["rows"][:, 0] = n = np.bincount(of, minlength=fits)
        tree["value"][:, 0] = np.bincount(of, r, fits) / np.maximum(1, n)
        node = np.uint8 if nodes < 255 else np.int16
        nowhere, leaf = nodes, np.zeros(len(self.y), node)
        open_gain, open_at = np.full((fits, nodes), -np.inf), np.zeros((fits, nodes, 2), np.int64)
        open_gain[:, 0], open_at[:, 0, 0], open_at[:, 0, 1] = self._best(base, fits, r)
        for s in range(self.splits):
            at = open_gain.argmax(1)
            gain = open_gain[every, at]
            found = gain > 1e-12
            if not found.any():
                break
            j, k, first = open_at[every, at, 0], open_at[every, at, 1], 1 + 3 * s
            which, split = every[found], at[found]
            tree["feature"][which, split], tree["cut"][which, split] = j[found], k[found]
            tree["child"][which, split], tree["gain"][which, split] = first, gain[found]
            open_gain[which, split] = -np.inf
            place = (j * len(self.y)).repeat(self.sizes)
            place += self.every
            v = self.bins.ravel().take(place)  # of each row, its bin of the variable that its fit splits by
            side = (v > k.astype(np.uint8).repeat(self.sizes)).view(np.uint8)
            side += v == BINS  # NULLs, which are above all cuts, go to the third child
            side = side + node(first)
            if s == 0 and found.all():
                leaf = side
            else:
                np.copyto(leaf, side, where=leaf == np.where(found, at, nowhere).astype(node).repeat(self.sizes))
            went = leaf.take(rows)
            drawn = np.flatnonzero(went >= first)
            group, r_of = 3 * of.take(drawn) + (went.take(drawn) - node(first)), r.take(drawn)
            n = np.bincount(group, minlength=3 * fits).reshape(fits, 3)
            total = np.bincount(group, r_of, 3 * fits).reshape(fits, 3)
            tree["rows"][:, first : first + 3] = n
            # where no NULL was seen, the node's own mean
            tree["value"][:, first : first + 3] = np.where(n > 0, total / np.maximum(1, n), tree["value"][every, at][:, None])
            if s + 1 < self.splits:
                # children of too few rows are never split: their histograms aren't made
                wide = np.flatnonzero(n.ravel() >= 2 * self.least)
                number = np.full(3 * fits, -1)
                number[wide] = np.arange(len(wide))
                group = number.take(group)
                kept = np.flatnonzero(group >= 0)
                if len(kept) < len(rows):
                    drawn, group, r_of = drawn.take(kept), group.take(kept), r_of.take(kept)
                owner, child = wide // 3, first + wide % 3
                own = base if len(drawn) == len(rows) else base.take(drawn, 1)
                own = own + (group - of.take(drawn)) * (self.width * (BINS + 1))
                open_gain[owner, child], open_at[owner, child, 0], open_at[owner, child, 1] = self._best(own, len(wide), r_of)
        self.f += (self.rate * tree["value"]).ravel().take(self.root + leaf)
        return tree, bagged


class Booster:
    """One model: arrays by (tree, node) of the split's variable (-1: a leaf), bin and first child, of the
    node's value and rows, and of the split's gain."""

    FIELDS = ("feature", "cut", "child", "value", "rows", "gain")
    STORED = {"feature": "<i2", "cut": "<i2", "child": "<i2", "rows": "<i4", "value": "<f8", "gain": "<f4"}

    def __init__(self, names: list[str], rate: float = 0.01, splits: int = 2, bag: float = 0.5, least: int = 10, seed: int = 0) -> None:
        self.names, self.rate, self.splits, self.bag, self.least, self.seed = names, rate, splits, bag, least, seed
        self.edges: list[np.ndarray] = []
        self.start = 0.0
        for name in self.FIELDS:
            setattr(self, name, np.zeros((0, 1 + 3 * splits), float if name in ("value", "gain") else np.int32))

    @property
    def trees(self) -> int:
        return len(self.value)

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int) -> np.ndarray:
        """Grows the trees; gives the out-of-bag estimate of the squared error after each of them."""
        (one,), (errors,) = fit_all([(x, y, self.seed)], self.names, self.rate, self.splits, trees, 1, self.bag, self.least, cut=False)
        self.__dict__ |= one.__dict__
        return errors

    def take(self, model: dict[str, np.ndarray], columns: Sequence[int], names: Sequence[str]) -> Booster:
        """Trees over some of the columns: those that may be split."""
        self.names, number = list(names), np.full(max(columns, default=0) + 2, -1)
        number[np.asarray(columns, int)] = np.arange(len(columns))
        for name in self.FIELDS:
            setattr(self, name, model[name])
        self.feature = number[model["feature"]]  # -1 stays: the last place
        return self

    def leaves(self, b: np.ndarray, first: int, last: int) -> np.ndarray:
        """The leaf of each row in some of the trees, by (tree, row)."""
        at, each = np.zeros((last - first, len(b)), np.int64), np.arange(first, last)[:, None]
        bt = b.T if b.shape[1] else np.zeros((1, len(b)), np.int64)
        for _ in range(self.splits):
            j = self.feature[each, at]
            v = bt[np.maximum(j, 0), np.arange(len(b))[None]]
            side = np.where(v == BINS, 2, (v > self.cut[each, at]).astype(np.int64))
            at = np.where(j >= 0, self.child[each, at] + side, at)
        return at

    def predict(self, x: np.ndarray, trees: int | None = None) -> np.ndarray:
        out, b, n = np.full(len(x), self.start), binned(x, self.edges), self.trees if trees is None else min(trees, self.trees)
        for k in range(0, n, CHUNK):
            last = min(n, k + CHUNK)
            out += self.rate * np.take_along_axis(self.value[k:last], self.leaves(b, k, last), 1).sum(0)
        return out

    def _spans(self, j: int, first: int, last: int, b: np.ndarray | None):
        """Of each node of some trees: whether it is a leaf, the span of bins of variable ``j`` that leads to it, and by
        row of ``b`` whether the splits of other variables do (without rows: the share of the fit's rows)."""
        t, nodes = last - first, self.value.shape[1]
        every = np.arange(t)
        low, high = np.zeros((t, nodes), np.int64), np.full((t, nodes), BINS + 1)
        share = np.ones((nodes, t, 1 if b is None else len(b)), float if b is None else bool)
        feature, cut, child, rows = (x[first:last] for x in (self.feature, self.cut, self.child, self.rows))
        there = np.zeros((t, nodes), bool)
        there[:, 0] = True
        for s in range(self.splits):
            c = 1 + 3 * s
            parent = (child == c).argmax(1)
            has = (child == c).any(1)
            there[:, c : c + 3] = has[:, None]
            f, k = feature[every, parent], cut[every, parent]
            own, before = f == j, share[parent, every]
            lo, hi = low[every, parent], high[every, parent]
            ends = ((lo, np.minimum(hi, k + 1)), (np.maximum(lo, k + 1), np.minimum(hi, BINS)), (np.maximum(lo, BINS), hi))
            if b is None:
                n = rows[:, c : c + 3].astype(float)
                parts = np.where(own[:, None], 1.0, n / np.maximum(1.0, n.sum(1, keepdims=True)))
            else:
                v = b.T[np.maximum(f, 0)]
                side = np.where(v == BINS, 2, (v > k[:, None]).astype(np.int64))
            for i in range(3):
                low[:, c + i], high[:, c + i] = np.where(own, ends[i][0], lo), np.where(own, ends[i][1], hi)
                share[c + i] = before * parts[:, i : i + 1] if b is None else before & (own[:, None] | (side == i))
        leaf = there & (feature < 0)
        return leaf, low, np.maximum(low, high), share

    def partial_dependence(self, name: str, values: np.ndarray) -> np.ndarray:
        """Mean prediction at each value of one variable: the other splits are followed to all sides, with
        the shares of the rows that went there in the fit."""
        j = self.names.index(name)
        steps = np.zeros(BINS + 2)
        for k in range(0, self.trees, CHUNK):
            last = min(self.trees, k + CHUNK)
            leaf, low, high, share = self._spans(j, k, last, None)
            weight = (self.value[k:last] * share[:, :, 0].T)[leaf]
            steps += np.bincount(low[leaf], weight, BINS + 2) - np.bincount(high[leaf], weight, BINS + 2)
        by_bin = self.start + self.rate * np.cumsum(steps)
        return by_bin[np.where(np.isnan(values), BINS, np.searchsorted(self.edges[j], values, side="left"))]

    def mean_over_rows(self, name: str, values: np.ndarray, x: np.ndarray, undo=None) -> np.ndarray:
        """At each value of one variable, the mean prediction over the rows ``x`` with that value put in; ``undo`` is
        applied to each prediction before the mean.

        The rows go through each tree's other splits once. A leaf's value counts over the span of bins of the
        variable that leads to it, so sums along the bins give the predictions at all values: the work of a tree
        is that of its rows and of the bins, however many values there are.
        """
        j, b = self.names.index(name), binned(x, self.edges)
        steps = np.zeros((len(x) if undo else 1, BINS + 2))
        each = max(1, min(CHUNK, 2_000_000 // max(1, len(x))))
        for k in range(0, self.trees, each):
            last = min(self.trees, k + each)
            leaf, low, high, share = self._spans(j, k, last, b)
            for node in range(self.value.shape[1]):
                own = np.flatnonzero(leaf[:, node])
                lo, hi, value, rows = low[own, node], high[own, node], self.value[k:last][own, node], share[node][own]
                if undo is None:
                    weight = value * rows.mean(1)
                    steps[0] += np.bincount(lo, weight, BINS + 2) - np.bincount(hi, weight, BINS + 2)
                elif len(own):
                    ends = np.zeros((len(own), BINS + 2))
                    ends[np.arange(len(own)), lo] += value
                    ends[np.arange(len(own)), hi] -= value
                    steps += rows.astype(float).T @ ends
        by_bin = self.start + self.rate * np.cumsum(steps, 1)
        by_bin = undo(by_bin).mean(0) if undo else by_bin[0]
        return by_bin[np.where(np.isnan(values), BINS, np.searchsorted(self.edges[j], values, side="left"))]

    def influence(self) -> dict[str, float]:
        """Share of the squared-error gains of each variable, in per cent."""
        split = self.feature >= 0
        gain = np.bincount(self.feature[split], self.gain[split], len(self.names)) if self.names else np.zeros(0)
        return dict(zip(self.names, (100 * gain / gain.sum() if gain.sum() else gain).tolist(), strict=True))

    def dumps(self) -> bytes:
        """Compressed: the length of ``about`` (JSON), ``about``, all borders one after the other, then the arrays of ``STORED``
        in their order, little-endian."""
        about = json.dumps({"names": self.names, "rate": self.rate, "start": self.start, "splits": self.splits, "edges": [len(e) for e in self.edges], "trees": self.trees}).encode()
        arrays = [np.concatenate([np.zeros(0), *self.edges]).astype("<f8"), *(getattr(self, k).astype(v) for k, v in self.STORED.items())]
        return zlib.compress(b"".join([len(about).to_bytes(4, "little"), about, *(a.tobytes() for a in arrays)]), 1)

    @classmethod
    def loads(cls, data: bytes) -> Booster:
        data = bytes(data)
        if data[:2] == b"PK":  # numpy's archive of arrays, as models were stored before
            with np.load(io.BytesIO(data), allow_pickle=False) as found:
                d, edges, arrays = json.loads(found["about"].tobytes()), found["edges"], {name: found[name] for name in cls.FIELDS}
        else:
            data = zlib.decompress(data)
            at = 4 + int.from_bytes(data[:4], "little")
            d, arrays = json.loads(data[4:at]), {}
            edges, shape = np.frombuffer(data, "<f8", sum(d["edges"]), at), (d["trees"], 1 + 3 * d["splits"])
            at += edges.nbytes
            for name, kind in cls.STORED.items():
                arrays[name] = np.frombuffer(data, kind, shape[0] * shape[1], at).reshape(shape)
                at += arrays[name].nbytes
        out = cls(d["names"], d["rate"], d["splits"])
        out.start, out.edges = d["start"], np.split(edges, np.cumsum(d["edges"])[:-1]) if d["edges"] else []
        for name in cls.FIELDS:
            setattr(out, name, arrays[name].astype(float if name in ("value", "gain") else np.int64))
        return out


def keep_memory() -> None:
    """A step of ``Lockstep`` makes and frees arrays of the same sizes: its process keeps up to 64 MB of them, rather than to give
    them back and to have them zeroed anew at each step."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 32 << 20)  # arrays up to this size come from the heap
        libc.mallopt(-1, 64 << 20)  # what the heap's end may hold
    except (OSError, AttributeError):  # not the GNU library
        pass


def _turned(errors: np.ndarray, t: int, patience: int | None) -> np.ndarray:
    """Whether each curve of errors (by tree, fit) has turned: its least is ``patience`` trees back, and as many trees as
    came before it."""
    if patience is None:
        return np.zeros(errors.shape[1], bool)
    least = np.nan_to_num(errors[:t], nan=np.inf).argmin(0) + 1
    return t >= least + np.maximum(patience, least)


def fit_all(members: Sequence[tuple[np.ndarray, np.ndarray, int]], names: Sequence[str], rate: float, splits: int, trees: int, folds: int, bag: float = 0.5, least: int = 10, patience: int | None = 1_000, cut: bool = True) -> tuple[list[Booster], list[np.ndarray]]:
    """Models of all members (x, y, seed), side by side, and each one's curve of squared errors by number of trees.

    With folds, all of a member's folds grow together and their errors are summed into one curve as they come;
    a member whose curve has turned drops out. Its number of trees is where the curve is least; then it
    is fitted on all its rows. Without folds (or with too few rows for them) the out-of-bag estimate decides.
    """
    edges = [quantile_edges(x) for x, _, _ in members]
    bins = [binned(x, e) for (x, _, _), e in zip(members, edges, strict=True)]
    size = np.array([len(y) for _, y, _ in members])
    seeds = np.array([s for _, _, s in members], np.uint64)
    width, count = len(names), len(members)
    wanted, curves = np.full(count, trees), [np.zeros(0)] * count

    def together(which: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        b, y = [bins[i] for i in which], [members[i][1] for i in which]
        return (np.concatenate(b) if b else np.zeros((0, width), np.int64)), (np.concatenate(y) if y else np.zeros(0))

    fold_of = [_mixed(np.arange(n).astype(np.uint64) + seeds[i : i + 1] * np.uint64(0xA0761D6478BD642F)) % np.uint64(max(1, folds)) for i, n in enumerate(size)]
    pairs = [(i, h) for i in range(count) for h in range(folds) if folds > 1 and 0 < (fold_of[i] == h).sum() < size[i]]
    by_folds = np.isin(np.arange(count), [i for i, _ in pairs])
    if pairs:
        owner = np.array([i for i, _ in pairs])
        b, y = together(owner)
        of = np.repeat(np.arange(len(pairs)), size[owner])
        learns = np.concatenate([fold_of[i] != h for i, h in pairs])
        run = Lockstep(b, y, of, learns, seeds[owner] + np.array([h + 1 for _, h in pairs], np.uint64), rate, splits, bag, least)
        held = np.bincount(owner, [(fold_of[i] == h).sum() for i, h in pairs], count)
        errors = np.full((trees, count), np.nan)
        for t in range(trees):
            run.grow()
            sse = np.bincount(owner, run.held_out(), count)  # the folds' errors, merged
            on = np.unique(owner)
            errors[t, on] = sse[on] / held[on]
            if (t + 1) % LOOK == 0:
                going = ~_turned(errors, t + 1, patience)[owner]
                if not going.any():
                    break
                if not going.all():
                    run.keep(going)
                    owner = owner[going]
        for i in np.flatnonzero(by_folds):
            curve = errors[:, i]
            curves[i] = curve[~np.isnan(curve)]
            wanted[i] = int(np.argmin(curves[i])) + 1
    order = np.argsort(wanted, kind="stable") if cut else np.arange(count)
    grown: list[list[dict]] = [[] for _ in range(count)]
    b, y = together(order)
    of, now = np.repeat(np.arange(count), size[order]), order.copy()
    run = Lockstep(b, y, of, np.ones(len(y), bool), seeds[order], rate, splits, bag, least)
    start = dict(zip(order.tolist(), run.start.tolist(), strict=True))
    n = np.bincount(of, minlength=count)
    estimate, error = np.bincount(of, (y - run.f) ** 2, count) / np.maximum(1, n), np.full((trees, count), np.nan)
    for t in range(int(wanted.max(initial=0))):
        before = run.y - run.f
        tree, bagged = run.grow()
        if not by_folds[now].all() or not cut:
            out = ~bagged
            gone = np.bincount(run.of[out], (run.y[out] - run.f[out]) ** 2 - before[out] ** 2, run.fits) / np.maximum(1, np.bincount(run.of[out], minlength=run.fits))
            estimate += gone
            error[t, now] = estimate
        for k, i in enumerate(now.tolist()):
            grown[i].append({name: v[k] for name, v in tree.items()})
        if (t + 1) % LOOK == 0:
            going = wanted[now] > t + 1
            if cut:
                going &= by_folds[now] | ~_turned(error, t + 1, patience)[now]
            if not going.any():
                break
            if not going.all():
                estimate = estimate[going]
                run.keep(going)
                now = now[going]
    models = []
    for i in range(count):
        if not by_folds[i]:
            curves[i] = error[:, i][~np.isnan(error[:, i])]
            wanted[i] = int(np.argmin(curves[i])) + 1 if cut and len(curves[i]) else len(curves[i])
        kept = grown[i][: wanted[i]]
        one = {name: np.stack([t[name] for t in kept]) if kept else np.zeros((0, 1 + 3 * splits)) for name in Booster.FIELDS}
        columns = [j for j in range(width) if not np.isnan(members[i][0][:, j]).all()]
        m = Booster([], rate, splits, bag, least, int(seeds[i])).take(one, columns, [names[j] for j in columns])
        m.start, m.edges = start[i], [edges[i][j] for j in columns]
        models.append(m)
    return models, curves
