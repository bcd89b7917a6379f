"""Cover trees of small integer points, for nearest-entry assignment of whole subtrees.

A tree is built for the points of one block. Farthest-first order gives nested
nets: the points whose distance to all earlier ones exceeds r are more than r
apart and cover the rest within r. Halving r gives the levels, every net point
hangs on its nearest point of the level above, and every point hangs on its
nearest point of the last net. Points are laid out so that a subtree is one run
of places; a node is (centre, run, radius), and the sum of a subtree is the
difference of two cumulative sums.
"""

from __future__ import annotations

import numpy as np

#: Net points of a tree; below them stand the points themselves.
NET = 128
#: Relative slack of the triangle inequality, far above the rounding of doubles.
SLACK = 1e-9


class Tree:
    """order: place -> row of the block; for each level the nodes' centres (rows), first places, and radii."""

    def __init__(self, order: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.order, self.levels = order, levels


def build(points: np.ndarray, net: int = NET) -> Tree:
    """The cover tree of the rows of an integer matrix."""
    x = points.astype(np.float64)
    n = len(x)
    near = np.full(n, np.inf)
    owner = np.zeros(n, np.int64)
    chosen, reach = [], []
    for j in range(min(net, n)):
        i = int(near.argmax()) if j else 0
        if j and near[i] == 0:
            break
        chosen.append(i)
        reach.append(near[i])
        diff = x - x[i]
        d = np.einsum("ij,ij->i", diff, diff)
        closer = d < near
        owner[closer] = j
        np.minimum(near, d, out=near)
    centre = np.array(chosen)
    reach = np.sqrt(np.array(reach))
    # Sizes of the nested nets, for radii halved from level to level.
    sizes, r = [1], reach[1] if len(reach) > 1 else 0.0
    while sizes[-1] < len(centre):
        r /= 2
        size = int((reach > r).sum())
        if size > sizes[-1]:
            sizes.append(size)
    gap = x[centre][:, None] - x[centre][None]
    gap = (gap * gap).sum(-1)
    # Each point's node at every level, from the last one up.
    path = [owner]
    for size in reversed(sizes[:-1]):
        parent = gap[:, :size].argmin(1)
        parent[:size] = np.arange(size)
        path.append(parent[path[-1]])
    path.reverse()
    order = np.lexsort(path[::-1])
    levels = []
    for of in path:
        of = of[order]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        node = centre[of[first]]
        diff = x[order] - np.repeat(x[node], np.diff(np.append(first, n)), axis=0)
        far = np.sqrt(np.maximum.reduceat(np.einsum("ij,ij->i", diff, diff), first))
        levels.append((node, first, far))
    return Tree(order, levels)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact: each point's nearest entry (ties to the lower index) and its squared distance, in integers."""
    diff = points[:, None] - entries[None]
    d = np.einsum("ijk,ijk->ij", diff, diff)
    own = d.argmin(1)
    return own, d[np.arange(len(d)), own]


def _settled(points: np.ndarray, entries: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each centre, and whether it is the nearest of all points within the radius."""
    diff = points[:, None] - entries[None]
    d = np.einsum("ijk,ijk->ij", diff, diff)
    own = d.argmin(1)
    rows = np.arange(len(d))
    first = np.sqrt(d[rows, own].astype(np.float64))
    rest = d.astype(np.float64)
    rest[rows, own] = np.inf
    second = np.sqrt(rest.min(1))
    return own, (radius == 0) | ((first + radius) * (1 + SLACK) < (second - radius) * (1 - SLACK))


def assign(tree: Tree, points: np.ndarray, entries: np.ndarray):
    """Runs of places (first, end, entry) settled as whole subtrees, the rows that were compared one by one with
    their entries, and the number of comparisons with entries."""
    runs = ([], [], [])
    n = len(points)
    open_runs = np.array([0]), np.array([n])  # first and end of the runs still ambiguous
    compared = 0
    for node, first, radius in tree.levels:
        end = np.append(first[1:], n)
        lo = np.searchsorted(first, open_runs[0])
        hi = np.searchsorted(first, open_runs[1])
        at = np.repeat(lo - np.append(0, np.cumsum(hi - lo)[:-1]), hi - lo) + np.arange(int((hi - lo).sum()))
        own, sure = _settled(points[node[at]], entries, radius[at])
        compared += len(at) * len(entries)
        for out, v in zip(runs, (first[at][sure], end[at][sure], own[sure])):
            out.append(v)
        open_runs = first[at][~sure], end[at][~sure]
        if not len(open_runs[0]):
            break
    size = open_runs[1] - open_runs[0]
    places = np.repeat(open_runs[0] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(int(size.sum()))
    rows = tree.order[places]
    own, _ = nearest(points[rows], entries) if len(rows) else (np.zeros(0, np.int64), None)
    return tuple(np.concatenate(r) for r in runs), rows, own, compared + len(rows) * len(entries)
