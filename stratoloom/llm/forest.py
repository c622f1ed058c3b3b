"""A forest of random-projection trees, searched through one priority queue over all trees."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Balanced trees of equal depth in heap order: node i of a tree has the children 2i+1 and 2i+2."""

    depth: int
    normals: np.ndarray  # trees x inner nodes x dimensions
    offsets: np.ndarray  # trees x inner nodes
    leaf_share: np.ndarray  # trees x leaves, share of the sample

    @property
    def trees(self) -> int:
        return len(self.normals)

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Signed distances to all hyperplanes: trees x nodes x rows, positive on the right side."""
        return np.einsum("tnd,rd->tnr", self.normals, x, optimize=True) - self.offsets[:, :, None]

    def leaf_priorities(self, x: np.ndarray) -> np.ndarray:
        """For rows x all leaves (trees side by side): the least signed margin on the way to the leaf.

        Opening leaves in falling order of this is what the search with one priority queue over
        all trees does (:meth:`search`); here it is done for many rows at once.
        """
        m = self.margins(x) if self.depth else None
        level = np.full((self.trees, 1, len(x)), np.inf, dtype=np.float32)
        for d in range(self.depth):
            here = m[:, (1 << d) - 1 : (1 << (d + 1)) - 1, :]
            nxt = np.empty((self.trees, 2 << d, len(x)), dtype=np.float32)
            nxt[:, 0::2] = np.minimum(level, -here)
            nxt[:, 1::2] = np.minimum(level, here)
            level = nxt
        return level.reshape(self.trees * self.leaves, len(x)).T

    def homes(self, x: np.ndarray) -> np.ndarray:
        """For rows x the leaf of every tree in which they lie: rows x trees, numbered over all trees."""
        out = np.empty((len(x), self.trees), dtype=np.int64)
        for t in range(self.trees):
            at = np.zeros(len(x), dtype=np.int64)
            for d in range(self.depth):
                node = (1 << d) - 1 + at
                at = 2 * at + (np.einsum("rd,rd->r", x, self.normals[t, node]) > self.offsets[t, node])
            out[:, t] = at + t * self.leaves
        return out

    def opened(self, x: np.ndarray, visits: int) -> np.ndarray:
        """For rows x the ``visits`` leaves that the queue over all trees opens first: rows x visits.

        Few leaves are scored all at once; where there are many, every row keeps a queue of its own
        (a row of arrays) and only the nodes on the way to its leaves are looked at.  Both open the
        same leaves, up to ties.
        """
        k = min(visits, self.trees * self.leaves)
        if self.trees * self.leaves <= 2048:
            return np.argpartition(-self.leaf_priorities(x), k - 1, axis=1)[:, :k]
        n = len(x)
        rows = np.arange(n)
        prio = np.full((n, self.trees + 64), -np.inf, dtype=np.float32)
        node = np.zeros(prio.shape, dtype=np.int64)  # (tree << 32 | depth << 26) + place within the level
        prio[:, : self.trees] = np.inf
        node[:, : self.trees] = np.arange(self.trees) << 32
        out, found = np.full((n, k), -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        free = self.trees
        live = rows
        while len(live):
            if free == prio.shape[1]:
                prio = np.concatenate([prio, np.full((n, 64), -np.inf, dtype=np.float32)], axis=1)
                node = np.concatenate([node, np.zeros((n, 64), dtype=np.int64)], axis=1)
            best = prio[live, :free].argmax(axis=1)
            p, code = prio[live, best], node[live, best]
            tree, depth, place = code >> 32, code >> 26 & 63, code & (1 << 26) - 1
            leaf = depth == self.depth
            hit = live[leaf]
            out[hit, found[hit]] = tree[leaf] * self.leaves + place[leaf]
            found[hit] += 1
            prio[hit, best[leaf]] = -np.inf
            go = live[~leaf]
            tree, depth, place, p = tree[~leaf], depth[~leaf], place[~leaf], p[~leaf]
            inner = (1 << depth) - 1 + place
            s = np.einsum("rd,rd->r", x[go], self.normals[tree, inner]) - self.offsets[tree, inner]
            below = (tree << 32) + (depth + 1 << 26) + 2 * place
            prio[go, best[~leaf]], node[go, best[~leaf]] = np.minimum(p, -s), below
            prio[go, free], node[go, free] = np.minimum(p, s), below + 1
            free += 1
            live = live[found[live] < k]
        return out

    def search(self, x: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves that the queue opens for one row."""
        m = self.margins(x[None, :])[:, :, 0] if self.depth else None
        # the least margin on the way so far, negated, as the queue gives its smallest first
        queue = [(-np.inf, t, 0, 0) for t in range(self.trees)]
        heapq.heapify(queue)
        out: list[int] = []
        while queue and len(out) < visits:
            p, t, d, i = heapq.heappop(queue)
            if d == self.depth:
                out.append(t * self.leaves + i)
                continue
            s = m[t, (1 << d) - 1 + i]
            heapq.heappush(queue, (max(p, s), t, d + 1, 2 * i))
            heapq.heappush(queue, (max(p, -s), t, d + 1, 2 * i + 1))
        return out


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int = 3, tries: int = 8) -> Forest:
    """Trees over a sample of unit vectors.

    The direction of a split is the difference of two random rows of the node; of some tries that
    with the widest gap near the middle (in units of the spread) is taken, so that splits run between
    clusters where they can.
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    inner = (1 << depth) - 1
    normals = np.zeros((trees, inner, dim), dtype=np.float32)
    offsets = np.zeros((trees, inner), dtype=np.float32)
    share = np.zeros((trees, 1 << depth))
    for t in range(trees):
        parts = [np.arange(len(sample))]
        for d in range(depth):
            nxt = []
            for i, rows in enumerate(parts):
                node = (1 << d) - 1 + i
                x = sample[rows]
                best = (-1.0, rng.standard_normal(dim), 0.0)
                for _ in range(tries):
                    if len(rows) < 4:
                        break
                    a, b = rng.choice(len(rows), 2, replace=False)
                    w = x[a] - x[b]
                    norm = np.linalg.norm(w)
                    if norm < 1e-6:
                        continue
                    w = w / norm
                    p = np.sort(x @ w)
                    lo, hi = int(0.4 * len(p)), max(int(0.6 * len(p)), int(0.4 * len(p)) + 1)
                    gaps = np.diff(p[lo : hi + 1])
                    g = int(np.argmax(gaps))
                    score = gaps[g] / (p[-1] - p[0] + 1e-9)
                    if score > best[0]:
                        best = (score, w, (p[lo + g] + p[lo + g + 1]) / 2)
                w = best[1] / np.linalg.norm(best[1])
                c = best[2] if best[0] >= 0 else (float(np.median(x @ w)) if len(rows) else 0.0)
                normals[t, node], offsets[t, node] = w, c
                right = x @ w > c if len(rows) else np.zeros(0, bool)
                nxt += [rows[~right], rows[right]]
            parts = nxt
        share[t] = [len(p) / max(1, len(sample)) for p in parts]
    return Forest(depth, normals, offsets, share)
