"""Work on one tree or one distance matrix that a task holds whole; `trees` decides which ones are small enough."""

from __future__ import annotations

import numpy as np

from aligngrid.operators.kernel import ordered_tree


def neighbour_joining(i, j, d, inner: int, root: int) -> list[tuple[int, int, float]]:
    """(node, parent, length) of the BIONJ tree of the distances d of leaves i < j.

    The k-th merge makes node inner + k; the last three (or two) clusters hang on `root`. A merged pair (a > b) keeps the place
    of a; equal criteria go to the lowest (a, b).
    """
    leaves = np.unique(np.concatenate([i, j]))
    n = len(leaves)
    x, y = np.searchsorted(leaves, i), np.searchsorted(leaves, j)
    dist = np.zeros((n, n))
    dist[x, y] = dist[y, x] = d
    var = dist.copy()
    node, live, sums, out = leaves.astype(np.int64), np.arange(n), dist.sum(axis=1), []
    a_of, b_of = np.tril_indices(n, -1)
    for k in range(max(0, n - 3)):
        r = n - k
        if k:
            a_of, b_of = (live[z] for z in np.tril_indices(r, -1))
        crit = np.floor(((r - 2) * dist[a_of, b_of] - sums[a_of] - sums[b_of]) * 1e6 + 0.5)
        at = int(np.argmin(crit))  # pairs are in the order of (a, b)
        a, b = a_of[at], b_of[at]
        la = 0.5 * (dist[a, b] + (sums[a] - sums[b]) / (r - 2))
        lb = dist[a, b] - la
        rest = live[(live != a) & (live != b)]
        vab = var[a, b]
        lam = 0.5 if vab == 0 else min(1.0, max(0.0, 0.5 + (var[b, rest] - var[a, rest]).sum() / (2 * (r - 2) * vab)))
        new = lam * (dist[a, rest] - la) + (1 - lam) * (dist[b, rest] - lb)
        sums[rest] += new - dist[a, rest] - dist[b, rest]  # two neighbours less, one more
        dist[a, rest] = dist[rest, a] = new
        var[a, rest] = var[rest, a] = lam * var[a, rest] + (1 - lam) * var[b, rest] - lam * (1 - lam) * vab
        sums[a] = new.sum()
        out += [(int(node[a]), inner + k, max(0.0, la)), (int(node[b]), inner + k, max(0.0, lb))]
        node[a] = inner + k
        live = live[live != b]
    for a in live:
        others = live[live != a]
        if len(others) == 1:
            length = dist[a, others[0]] / 2
        else:
            length = 0.5 * (dist[a, others].sum() - dist[others[0], others[1]])
        out.append((int(node[a]), root, max(0.0, float(length))))
    return out


def pruned(node, parent, length, leaf, kept) -> list[tuple[int, int, float, int]]:
    """(node, parent, length, leaf) of the tree without the leaves that are not kept; nodes left with one child are merged away."""
    first, ids, up = ordered_tree(node, parent)
    n = len(first)
    size, tip = np.asarray(length, float)[first], [leaf[k] for k in first]
    some = np.zeros(n + 1, bool)
    below = np.zeros(n + 1, np.int64)  # children with kept leaves
    some[:n] = [t is not None and bool(kept[k]) for t, k in zip(tip, first)]
    own = some.copy()
    for b in range(n):
        if some[b] or below[b]:
            some[b] = True
            below[up[b]] += 1
    stay = own | (below > 1)
    above, far, out = np.full(n + 1, -1), np.zeros(n + 1), []
    for b in range(n - 1, -1, -1):
        p = up[b]
        above[b], far[b] = (p, size[b]) if stay[p] else (above[p], size[b] + far[p])
        if stay[b] and above[b] >= 0:
            out.append((int(ids[b]), int(ids[above[b]]), float(far[b]), tip[b]))
    return out


def leaf_matrix(node, parent, length, leaf) -> tuple[np.ndarray, np.ndarray]:
    """Leaf numbers in ascending order and the path lengths between them."""
    first, _, up = ordered_tree(node, parent)
    size = np.asarray(length, float)[first]
    tips = [leaf[k] for k in first]
    numbers = np.array(sorted(t for t in tips if t is not None))
    place = {t: i for i, t in enumerate(numbers.tolist())}
    dist = np.zeros((len(numbers), len(numbers)))
    held: list = [(np.zeros(0, np.int64), np.zeros(0))] * (len(first) + 1)
    for b in range(len(first)):
        who, far = (np.array([place[tips[b]]]), np.zeros(1)) if tips[b] is not None else held[b]
        far = far + size[b]
        other, rest = held[up[b]]
        dist[np.ix_(who, other)] = far[:, None] + rest[None, :]
        dist[np.ix_(other, who)] = dist[np.ix_(who, other)].T
        held[up[b]] = np.concatenate([other, who]), np.concatenate([rest, far])
        held[b] = None
    return numbers, dist


def covering_leaves(node, parent, length, leaf, k: int) -> list[tuple[int, int]]:
    """(leaf, round): the farthest pair, then each round the leaf that is attached farthest from the chosen ones."""
    node, length = np.asarray(node), np.asarray(length, float)
    rank = np.empty(len(node))
    rank[np.argsort(node)] = np.arange(1, len(node) + 1)
    length = np.where(length <= 1.2e-7, 1e-4 * rank / len(node), length)
    numbers, dist = leaf_matrix(node, parent, length, leaf)
    if len(numbers) < 2:
        return []
    x, y = np.triu_indices(len(numbers), 1)
    at = int(np.argmax(np.floor(dist[x, y] * 1e12 + 0.5)))  # the lowest of equal pairs
    p, q = x[at], y[at]
    chosen, out = [p, q], [(int(numbers[p]), 0), (int(numbers[q]), 0)]
    left = np.array([z for z in range(len(numbers)) if z not in (p, q)], np.int64)
    attached = (dist[p, left] + dist[q, left] - dist[p, q]) / 2
    for r in range(1, k - 1):
        if not len(left):
            break
        at = int(np.argmax(np.floor(attached * 1e9 + 0.5)))
        z = left[at]
        out.append((int(numbers[z]), r))
        left, attached = np.delete(left, at), np.delete(attached, at)
        c = np.array(chosen)
        half = (dist[np.ix_(c, left)] + dist[z, left][None, :] - dist[z, c][:, None]) / 2
        attached = np.minimum(attached, half.min(axis=0))
        chosen.append(z)
    return out


def fitch(node, parent, leaf, who, block, masks, sites) -> list[tuple[int, int, int]]:
    """(node, block, changed sites) of every inner node: bits of 64 sites a block.

    who, block: leaf and block of each row of masks (one array a state) and sites (the sites that are there). A leaf without rows
    may have any state.
    """
    first, ids, up = ordered_tree(node, parent)
    blocks, at = np.unique(block, return_inverse=True)
    rows: dict[int, list[int]] = {}
    for r, w in enumerate(who):
        rows.setdefault(int(w), []).append(r)
    masks, sites = np.array([np.asarray(m, np.int64) for m in masks]), np.asarray(sites, np.int64)
    shape = (len(first) + 1, len(masks), len(blocks))
    both, any_, seen = np.full(shape, -1), np.zeros(shape, np.int64), np.zeros((shape[0], shape[2]), np.int64)
    out = []
    for b in range(shape[0]):
        tip = leaf[first[b]] if b < len(first) else None
        if tip is not None:
            mine = rows.get(tip, [])
            both[b][:, at[mine]] = masks[:, mine]
            seen[b][at[mine]] = sites[mine]
            state = both[b]
        else:
            some = np.bitwise_or.reduce(both[b], axis=0)
            changed = ~some & seen[b]
            state = both[b] | (~some & any_[b])
            out += [(int(ids[b]), int(blocks[k]), int(changed[k])) for k in np.flatnonzero(seen[b])]
        if b < len(first):
            p = up[b]
            both[p] &= state
            any_[p] |= state
            seen[p] |= seen[b]
    return out


def sums_below(node, parent, numbers) -> list[list[int]]:
    """[node, sums..] of every node that has a parent: sums of some numbers of the nodes at or below it."""
    first, ids, up = ordered_tree(node, parent)
    held = np.zeros((len(first) + 1, len(numbers)), np.int64)
    held[:-1] = np.array([np.asarray(x, np.int64) for x in numbers]).T[first]
    for b in range(len(first)):
        held[up[b]] += held[b]
    return np.column_stack([ids[:-1], held[:-1]]).tolist()
