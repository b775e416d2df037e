"""Likelihood of one block of site patterns for a list of candidate parameter vectors.

The only numeric helper that runs inside tasks: numpy over a bounded block of
patterns. A candidate is the logs of the branch lengths, then the logs of the
model's own parameters in the order of `own_parameters`.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np

from aligngrid import catalog
from aligngrid.operators.models import codon_steps, gamma_rate_table, gamma_rates


@lru_cache(None)
def keep_memory() -> bool:
    """Freed arrays stay with the process, up to 128 MB of them: given back and asked for anew, their pages cost more than the
    arithmetic. Only where the C library has the setting."""
    try:
        tune = ctypes.CDLL(None).mallopt
        return bool(tune(-3, 32 << 20) and tune(-1, 128 << 20))  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
    except (AttributeError, OSError, TypeError):
        return False


def own_parameters(core: str, gamma: bool) -> list[str]:
    names = {"K2P": ["kappa"], "HKY": ["kappa"], "M0": ["kappa", "omega"],
             "REV": ["r_AC", "r_AG", "r_AT", "r_CG", "r_CT"]}.get(core, [])
    return names + (["alpha"] if gamma else [])


def exchange(core: str, k: int, par: dict, given, code: int = 0) -> np.ndarray:
    s = np.ones((k, k))
    if given is not None:
        s = np.zeros((k, k))
        s[np.tril_indices(k, -1)] = given
        s = s + s.T
    if core in ("K2P", "HKY"):
        for a, b in ((0, 2), (1, 3)):
            s[a, b] = s[b, a] = par["kappa"]
    elif core == "REV":
        for (a, b), name in zip(((0, 1), (0, 2), (0, 3), (1, 2), (1, 3)), own_parameters("REV", False)):
            s[a, b] = s[b, a] = par[name]
    elif core == "M0":
        s = np.zeros((k, k))
        i, j, ts, other = _steps(code)
        s[i, j] = np.where(ts, par["kappa"], 1.0) * np.where(other, par["omega"], 1.0)
    return s


@lru_cache(None)
def _steps(code: int):
    """i, j, transition, other amino acid of the pairs of codons that differ in a base."""
    i, j, ts, a1, a2 = np.array([x[:5] for x in codon_steps(code)]).T
    return i, j, ts == 1, a1 != a2


def decompose(s: np.ndarray, pi: np.ndarray):
    """Eigen form of the unit-rate Q: P(t) = left exp(lam t) right."""
    q = s * pi[None, :]
    np.fill_diagonal(q, 0.0)
    q /= pi @ q.sum(1)
    np.fill_diagonal(q, -q.sum(1))
    root = np.sqrt(pi)
    sym = root[:, None] * q / root[None, :]
    lam, u = np.linalg.eigh((sym + sym.T) / 2)
    return lam, u / root[:, None], (u * root[:, None]).T


class Block:
    """One block of patterns under one tree and model.

    up: place of each node's parent, children before parents, root last. leaf: row of `states` (leaves x patterns,
    -1 = gap) or -1.
    """

    def __init__(self, core, gamma, code, pi, given, up, leaf, states, counts):
        self.core, self.gamma, self.code, self.given = core, gamma, code, given
        self.pi, self.counts, self.up, self.leaf = np.asarray(pi), np.asarray(counts), np.asarray(up), np.asarray(leaf)
        self.k, self.nb = len(self.pi), len(self.up) - 1
        self.names = own_parameters(core, gamma)
        self.cols = np.where(states < 0, self.k, states)
        self.kids: list = [[] for _ in self.up]
        for b in range(self.nb):
            self.kids[self.up[b]].append(b)
        self.eigen: dict = {}

    def _model(self, x):
        par = dict(zip(self.names, np.exp(x[self.nb:])))
        rates = np.array(gamma_rates(float(par["alpha"]))) if self.gamma else np.ones(1)
        key = tuple(v for n, v in par.items() if n != "alpha")
        if key not in self.eigen:
            self.eigen[key] = decompose(exchange(self.core, self.k, par, self.given, self.code), self.pi)
        return rates, self.eigen[key]

    def _upwards(self, x, rates, eigen):
        """Messages of the branches (classes x states x patterns) and their log scales; the vectors below the nodes."""
        lam, left, right = eigen
        sent: list = [None] * self.nb
        below: list = [None] * (self.nb + 1)
        few = len(self.counts) < self.k
        wide_right = np.concatenate([right, right.sum(axis=1, keepdims=True)], axis=1)
        for b in range(self.nb + 1):  # children come first
            if self.kids[b]:
                v, scale = sent[self.kids[b][0]]
                for c in self.kids[b][1:]:
                    w, s = sent[c]
                    v, scale = v * w, scale + s
                    top = v.max(axis=(0, 1))
                    if top.min() < 1e-60:  # after each child, so that very many of them cannot reach 0
                        top = np.maximum(top, 1e-300)
                        v, scale = v / top, scale + np.log(top)
                below[b] = (v, scale)
            if b == self.nb:
                break
            t = min(float(np.exp(x[b])), catalog.MAX_BRANCH) * rates
            grow = np.exp(lam * t[:, None])
            if few:  # fewer patterns than states: the vectors go through the eigen form, P(t) itself is not made
                inner = wide_right[:, self.cols[self.leaf[b]]][None] if self.leaf[b] >= 0 else right @ below[b][0]
                sent[b] = (np.maximum(left @ (grow[:, :, None] * inner), 0.0), 0.0 if self.leaf[b] >= 0 else below[b][1])
                continue
            p = np.maximum((left * grow[:, None, :]) @ right, 0.0)
            if self.leaf[b] >= 0:
                wide = np.concatenate([p, np.ones(p.shape[:2] + (1,))], axis=2)
                sent[b] = (wide[:, :, self.cols[self.leaf[b]]], 0.0)
            else:
                sent[b] = (p @ below[b][0], below[b][1])
        return sent, below

    def _sum(self, at_root, rates) -> float:
        v, scale = at_root
        like = np.einsum("k,ckm->m", self.pi, v) / len(rates)
        return float(self.counts @ (np.log(np.maximum(like, 1e-300)) + scale))

    def class_lnl(self, x, rates) -> np.ndarray:
        """Log-likelihood of each pattern in each of the given rate classes (classes x patterns)."""
        _, eigen = self._model(np.asarray(x))
        v, scale = self._upwards(x, np.asarray(rates), eigen)[1][-1]
        return np.log(np.maximum(np.einsum("k,ckm->cm", self.pi, v), 1e-300)) + scale

    def vectors(self, x, rates) -> list:
        """(vector, log scale) of each node: the likelihood of the data below it (classes x states x patterns)."""
        _, eigen = self._model(np.asarray(x))
        below = self._upwards(x, np.asarray(rates), eigen)[1]
        tips = np.concatenate([np.eye(self.k), np.ones((self.k, 1))], axis=1)
        for b in range(self.nb):
            if self.leaf[b] >= 0:
                wide = np.broadcast_to(tips[:, self.cols[self.leaf[b]]], (len(rates), self.k, len(self.counts)))
                below[b] = (wide, 0.0)
        return below

    def lnl(self, x) -> float:
        x = np.asarray(x)
        rates, eigen = self._model(x)
        return self._sum(self._upwards(x, rates, eigen)[1][-1], rates)

    def slopes(self, x, step: float) -> list[float]:
        """lnL; its slope and then its curvature in the log of each branch; lnL with each own parameter and at last the whole
        tree a step up; the same a step down."""
        return [*self.branch_slopes(x), *[self.lnl(y) for y in self.nudged(x, step)]]

    def nudged(self, x, step: float) -> list[np.ndarray]:
        """x with each own parameter and at last the whole tree a step up, then down."""
        x, out = np.asarray(x), []
        for h in (step, -step):
            for j in range(self.nb, len(x)):
                y = x.copy()
                y[j] += h
                out.append(y)
            y = x.copy()
            y[:self.nb] += h
            out.append(y)
        return out

    def branch_slopes(self, x) -> list[float]:
        """lnL; its slope and then its curvature in the log of each branch.

        One pass up and one down give all branches: what a branch sees from above (outside) and from below meet in the
        eigen form of P(t), where a derivative is a factor lam.
        """
        x = np.asarray(x)
        rates, eigen = self._model(x)
        lam, left, right = eigen
        sent, below = self._upwards(x, rates, eigen)
        outside: list = [None] * (self.nb + 1)
        outside[self.nb] = np.broadcast_to(self.pi[None, :, None], (len(rates), self.k, len(self.counts)))
        slope, bend = np.zeros(self.nb), np.zeros(self.nb)
        wide_right = np.concatenate([right, right.sum(axis=1, keepdims=True)], axis=1)
        for p in range(self.nb, -1, -1):
            kids = self.kids[p]
            # products of the other children, from both ends
            after = [None] * len(kids)
            run = None
            for i in range(len(kids) - 1, -1, -1):
                after[i] = run
                run = _scaled(sent[kids[i]][0] if run is None else run * sent[kids[i]][0])
            run = outside[p]
            for i, b in enumerate(kids):
                seen = run if after[i] is None else _scaled(run * after[i])
                t = min(float(np.exp(x[b])), catalog.MAX_BRANCH)
                grow = np.exp(lam * (t * rates)[:, None])[:, :, None]
                inner = wide_right[:, self.cols[self.leaf[b]]][None] if self.leaf[b] >= 0 else right @ below[b][0]
                outer = left.T @ seen
                term = outer * grow * inner
                speed = (lam[None, :] * rates[:, None])[:, :, None]
                like = np.maximum(term.sum(axis=(0, 1)), 1e-300)
                first = (term * speed).sum(axis=(0, 1)) / like
                second = (term * speed * speed).sum(axis=(0, 1)) / like
                slope[b] = t * (self.counts @ first)
                bend[b] = slope[b] + t * t * (self.counts @ (second - first * first))
                if self.leaf[b] < 0:
                    outside[b] = _scaled(np.maximum(right.T @ (grow * outer), 0.0))
                run = _scaled(run * sent[b][0])
        return [self._sum(below[-1], rates), *slope, *bend]


class Forest:
    """Trees with a block of patterns each, over one alphabet: nodes of the same depth of all of them are pruned in one pass.

    tree, up, leaf: of each node its tree, the place of its parent (len(up) + tree for a root) and the row of `cols` it shows or -1.
    cols: rows x patterns, the last state + 1 for a gap.
    """

    def __init__(self, tree, up, leaf, cols, k: int):
        keep_memory()
        self.tree, self.leaf, self.cols, self.k = tree, leaf, cols, k
        n = len(up)
        depth = _depths(up)
        order = np.lexsort((up, depth))
        ends = np.flatnonzero(np.diff(depth[order], append=0))[::-1] + 1
        self.levels = []
        for a, b in zip([*ends[1:], 0], ends):
            kids = order[a:b]
            parents, first, count = np.unique(up[kids], return_index=True, return_counts=True)
            self.levels.append((kids, parents, first, count))
        inner = leaf < 0
        if not np.isin(np.flatnonzero(inner), up).all() or (~inner)[up[up < n]].any():
            raise ValueError("a leaf of a tree has children or an inner node none")

    def upwards(self, eigen, t):
        """Level by level from the deepest, the root last: (places of the inner nodes, vectors below them (nodes x classes x
        patterns x states), their log scales (nodes x patterns)). eigen: of `decompositions`; t: nodes x classes."""
        lam, left, right = eigen
        left, right = left.transpose(0, 2, 1), right.transpose(0, 2, 1)
        few = self.cols.shape[1] < self.k
        wide = np.concatenate([right, right.sum(axis=1, keepdims=True)], axis=1) if few else None
        made, v, scale = None, None, None
        for kids, parents, first, count in self.levels:
            of, rows = self.tree[kids], self.leaf[kids]
            tip, held = np.flatnonzero(rows >= 0), np.flatnonzero(rows < 0)
            grow = np.exp(lam[of][:, None, :] * t[kids][:, :, None])
            sent = np.empty((len(kids), t.shape[1], self.cols.shape[1], self.k))
            scales = np.zeros((len(kids), self.cols.shape[1]))
            shown = self.cols[rows[tip]]
            if len(held):
                at = np.searchsorted(made, kids[held])
                scales[held] = scale[at]
            if few:  # fewer patterns than states: the vectors go through the eigen form, P(t) itself is not made
                if len(tip):
                    sent[tip] = wide[of[tip][:, None], shown][:, None]
                if len(held):
                    sent[held] = _by_tree(v[at], right, of[held])
                sent *= grow[:, :, None, :]
                sent = _by_tree(sent, left, of)
                np.maximum(sent, 0.0, out=sent)
            else:
                p = np.maximum((right[of][:, None] * grow[:, :, None, :]) @ left[of][:, None], 0.0)
                if len(tip):
                    of_tip = np.concatenate([p[tip], np.ones((len(tip), t.shape[1], 1, self.k))], axis=2)
                    sent[tip] = of_tip[np.arange(len(tip))[:, None, None], np.arange(t.shape[1])[None, :, None], shown[:, None, :]]
                if len(held):
                    sent[held] = v[at] @ p[held]
            made, even = parents, count.min() == count.max()
            if even:  # kids are in the order of their parents
                sent, scales = (z.reshape(len(parents), count[0], *z.shape[1:]) for z in (sent, scales))
                v, scale = (sent[:, 0] * sent[:, 1], scales[:, 0] + scales[:, 1]) if count[0] > 1 else (sent[:, 0], scales[:, 0])
            else:
                v, scale = sent[first], scales[first]
            for j in range(1, count.max()):
                if not even:
                    more = np.flatnonzero(count > j)
                    v[more] *= sent[first[more] + j]
                    scale[more] += scales[first[more] + j]
                elif j > 1:
                    v *= sent[:, j]
                    scale += scales[:, j]
                top = v.max(axis=3).max(axis=1)
                if top.min() < 1e-60:  # after each child, so that very many of them cannot reach 0
                    top = np.maximum(top, 1e-300)
                    v /= top[:, None, :, None]
                    scale += np.log(top)
            yield parents, v, scale


def _by_tree(x: np.ndarray, m: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """x (nodes in the order of their trees x classes x patterns x states) times the matrix of each node's tree: one product a tree."""
    out = np.empty(x.shape)
    ends = [0, *(np.flatnonzero(np.diff(tree)) + 1), len(tree)]
    for a, b in zip(ends[:-1], ends[1:]):
        np.matmul(x[a:b].reshape(-1, x.shape[-1]), m[tree[a]], out=out[a:b].reshape(-1, x.shape[-1]))
    return out


def _depths(up: np.ndarray) -> np.ndarray:
    """Edges between each node and its root; places from len(up) on are roots."""
    n = len(up)
    depth, jump = np.ones(n, np.int64), up.copy()
    for _ in range(n.bit_length() + 1):
        open_ = np.flatnonzero(jump < n)
        if not len(open_):
            return depth
        to = jump[open_]
        depth[open_], jump[open_] = depth[open_] + depth[to], jump[to]
    raise ValueError("the edges of a tree run in a circle")


def forest_places(tree, node, parent) -> tuple[np.ndarray, np.ndarray]:
    """(place of each node's parent as `Forest` wants it, id of the root of each tree). tree: 0, 1, .. of each node."""
    ids, code = np.unique(np.concatenate([node, parent]), return_inverse=True)
    n = len(node)
    own, above = tree * len(ids) + code[:n], tree * len(ids) + code[n:]
    order = np.argsort(own, kind="stable")
    at = np.minimum(np.searchsorted(own[order], above), n - 1)
    place = order[at]
    top = own[place] != above
    roots = np.full(tree[-1] + 1, -1, np.int64)
    roots[tree[top]] = code[n:][top]
    if (roots < 0).any() or (code[n:][top] != roots[tree[top]]).any():
        raise ValueError("a tree has no root or several")
    return np.where(top, n + tree, place), ids[roots]


def decompositions(s: np.ndarray, pi: np.ndarray):
    """`decompose` of many models at once: s (models x states x states), pi (models x states)."""
    q = s * pi[:, None, :]
    at = np.arange(pi.shape[1])
    q[:, at, at] = 0.0
    q /= np.einsum("ri,rij->r", pi, q)[:, None, None]
    q[:, at, at] = -q.sum(2)
    root = np.sqrt(pi)
    sym = root[:, :, None] * q / root[:, None, :]
    lam, u = np.linalg.eigh((sym + sym.transpose(0, 2, 1)) / 2)
    return lam, u / root[:, :, None], (u * root[:, :, None]).transpose(0, 2, 1)


#: Numbers (nodes x classes x patterns x states) that are pruned together.
TOGETHER = 1 << 18


def together_lnl(blocks: list[Block], cands: list) -> list[np.ndarray]:
    """`Block.lnl` of each block for each of its candidates; blocks of one alphabet and number of rate classes are pruned together."""
    out = [np.empty(len(c)) for c in cands]
    kinds: dict = {}
    for i, b in enumerate(blocks):
        for j in range(len(cands[i])):
            kinds.setdefault((b.k, b.gamma), []).append((len(b.counts), i, j))
    for (k, gamma), rows in kinds.items():
        rows.sort()  # padded to the widest of a group
        rates = None
        if gamma:
            each, of = np.unique([np.exp(cands[i][j][blocks[i].nb + blocks[i].names.index("alpha")]) for _, i, j in rows], return_inverse=True)
            rates = dict(zip([(i, j) for _, i, j in rows], gamma_rate_table(each)[of]))
        group, held = [], 0
        for n, i, j in rows:
            held += blocks[i].nb + 1
            if group and held * n * k * (4 if gamma else 1) > TOGETHER:
                _group_lnl(blocks, cands, group, rates, out)
                group, held = [], blocks[i].nb + 1
            group.append((i, j))
        _group_lnl(blocks, cands, group, rates, out)
    return out


def _group_lnl(blocks: list[Block], cands: list, group: list, rates_of: dict | None, out: list) -> None:
    used = sorted({i for i, _ in group})
    k, wide = blocks[used[0]].k, max(len(blocks[i].counts) for i in used)
    first = dict(zip(used, np.cumsum([0] + [len(blocks[i].cols) for i in used])))
    cols = np.full((sum(len(blocks[i].cols) for i in used), wide), k)
    for i in used:
        cols[first[i]:first[i] + len(blocks[i].cols), :len(blocks[i].counts)] = blocks[i].cols
    tree = np.repeat(np.arange(len(group)), [blocks[i].nb for i, _ in group])
    n, low, up, leaf, t = len(tree), 0, [], [], []
    counts = np.zeros((len(group), wide))
    forms: dict = {}
    which, pi = [], np.array([blocks[i].pi for i, _ in group])
    for r, (i, j) in enumerate(group):
        b, x = blocks[i], np.asarray(cands[i][j])
        above = b.up[:b.nb]
        up.append(np.where(above < b.nb, above + low, n + r))
        leaf.append(np.where(b.leaf[:b.nb] >= 0, b.leaf[:b.nb] + first[i], -1))
        low += b.nb
        counts[r, :len(b.counts)] = b.counts
        par = dict(zip(b.names, np.exp(x[b.nb:])))
        t.append(np.minimum(np.exp(x[:b.nb]), catalog.MAX_BRANCH))
        key = (i, *(v for name, v in par.items() if name != "alpha"))
        if key not in forms:
            forms[key] = (len(forms), exchange(b.core, k, par, b.given, b.code), b.pi)
        which.append(forms[key][0])
    rates = np.ones((len(group), 1)) if rates_of is None else np.array([rates_of[at] for at in group])
    eigen = decompositions(np.array([f[1] for f in forms.values()]), np.array([f[2] for f in forms.values()]))
    forest = Forest(tree, np.concatenate(up), np.concatenate(leaf), cols, k)
    *_, (_, v, scale) = forest.upwards([e[which] for e in eigen], np.concatenate(t)[:, None] * rates[tree])
    like = np.einsum("rk,rcmk->rm", pi, v) / v.shape[1]
    lnl = (counts * (np.log(np.maximum(like, 1e-300)) + scale)).sum(axis=1)
    for (i, j), value in zip(group, lnl):
        out[i][j] = value


def ordered_tree(node, parent) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the nodes with children before their parents, the node ids in that order (root last), and the place of each one's
    parent."""
    node, parent = np.asarray(node), np.asarray(parent)
    ids = np.append(node, np.setdiff1d(parent, node))
    order = np.argsort(ids)
    up = np.append(order[np.searchsorted(ids, parent, sorter=order)], len(ids) - 1)
    depth, jump = np.append(np.ones(len(node), np.int64), 0), up.copy()
    while (jump != len(ids) - 1).any():
        depth, jump = depth + depth[jump], jump[jump]
    first = np.argsort(-depth, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[first] = np.arange(len(ids))
    return first[:-1], ids[first], place[up[first]]


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors of a pattern over their largest value; only ratios are read from them."""
    return v / np.maximum(v.max(axis=(0, 1)), 1e-300)


STEP = 0.01
SCALES = [0.3, 0.6, 1.0, 1.8, 3.0]
# (size along the direction, share of the last step), and (size along it, share of the whole tree's)
MOVES = [(0.3, 0.0), (0.6, 0.0), (1.0, 0.0), (1.0, 0.5), (1.0, 1.0), (0.6, 1.0), (1.3, 1.5), (1.0, 2.5)]
TREE_MOVES = [(0.5, 0.5), (0.5, 1.0), (0.0, 1.0)]


def climb(block: Block, x, lo, hi, rounds: int, tol: float) -> tuple[list[float], list[float], float, float, bool]:
    """(x, last step, lnL, last gain, converged) of the search that `fit` spreads over blocks, for an alignment of one block."""
    return climbs([block], [x], [lo], [hi], rounds, tol)[0]


def climbs(blocks: list[Block], xs, los, his, rounds: int, tol: float) -> list[tuple]:
    """`climb` of many blocks side by side: the candidates of all of them are pruned together."""
    los, his = ([np.asarray(z, float) for z in zs] for zs in (los, his))
    branch = [(np.arange(len(x)) < b.nb).astype(float) for b, x in zip(blocks, xs)]

    def best(some, cands, known=()):
        """The best candidate of each and its lnL; known: that of the first ones. Equal candidates are pruned once."""
        cands = [list({c.tobytes(): c for c in (np.clip(c, los[i], his[i]) for c in own)}.values()) for i, own in zip(some, cands)]
        skip = 1 if len(known) else 0
        values = together_lnl([blocks[i] for i in some], [own[skip:] for own in cands])
        if skip:
            values = [np.append(v, w) for v, w in zip(known, values)]
        at = [int(np.argmax(v)) for v in values]
        return [(own[k], float(v[k])) for own, v, k in zip(cands, values, at)]

    def starts(i):
        cands = [np.asarray(xs[i], float) + np.log(s) * branch[i] for s in SCALES]
        if blocks[i].core != "M0":
            return cands
        out = []
        for omega in catalog.OMEGA_STARTS:
            for c in cands:
                c = c.copy()
                c[blocks[i].nb + 1] = np.log(omega)
                out.append(c)
        return out

    every = range(len(blocks))
    state = [(x, np.zeros(len(x)), lnl, 1e300, False) for x, lnl in best(every, [starts(i) for i in every])]
    left = list(every)
    for _ in range(rounds):
        nudges = together_lnl([blocks[i] for i in left], [blocks[i].nudged(state[i][0], STEP) for i in left])
        cands = []
        for i, moves in zip(left, nudges):
            x, moved = state[i][:2]
            v = np.concatenate([blocks[i].branch_slopes(x), moves])
            n, m = blocks[i].nb, len(x) + 1
            up, down = v[1 + 2 * n:1 + n + m], v[1 + n + m:]
            slope = np.concatenate([v[1:1 + n], (up - down) / (2 * STEP)])
            bend = np.concatenate([v[1 + n:1 + 2 * n], (up + down - 2 * v[0]) / (STEP * STEP)])
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.where(bend < -1e-3, -slope / bend, np.sign(slope) * 0.7)
            d = np.clip(d, -1.0, 1.0)
            d1, d2 = d[:len(x)], d[-1] * branch[i]
            cands.append([x] + [x + s * d1 + t * moved for s, t in MOVES] + [x + s * d1 + t * d2 for s, t in TREE_MOVES])
        for i, (new, top) in zip(left, best(left, cands, [state[i][2] for i in left])):
            x, _, lnl, _, _ = state[i]
            state[i] = (new, new - x, top, top - lnl, top - lnl < tol)
            blocks[i].eigen.clear()  # forms of points that are left
        left = [i for i in left if not state[i][4]]
        if not left:
            break
    return [(x.tolist(), moved.tolist(), lnl, gain, done) for x, moved, lnl, gain, done in state]


def block_lnl(core, gamma, code, pi, given, up, leaf, states, counts, cands) -> list[float]:
    """lnL of the block for each candidate."""
    block = Block(core, gamma, code, pi, given, up, leaf, states, counts)
    return [block.lnl(x) for x in cands]


def block_slopes(core, gamma, code, pi, given, up, leaf, states, counts, x, step) -> list[float]:
    return Block(core, gamma, code, pi, given, up, leaf, states, counts).slopes(x, step)
