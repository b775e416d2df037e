"""Checks against brute force and invariants, above all for queries that have no SQL."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aligngrid import catalog
from aligngrid.operators import aggregate as A
from aligngrid.operators import fit, kernel, likelihood, models, pairs, parsimony, rank, recode, resample, trees
from aligngrid.plans import fixtures as X
from aligngrid.plans import files, ranking
from aligngrid.plans.recoding import cleaned
from aligngrid.session import cut, new_path
from aligngrid.sources import alignments, newick, settings, sinks

SF = "/root/testdata/sf0.001"


def sites_of(spark, seqs, family=0):
    return spark.createDataFrame(
        [(family, i, p, c) for i, s in enumerate(seqs) for p, c in enumerate(s)],
        "family bigint, seq_id bigint, pos bigint, ch string")


# ---- distances and trees ---------------------------------------------------------------------

def plain_bionj(d):
    """Splits and total length, by the textbook recurrences on a dense matrix."""
    n = len(d)
    d, v = d.copy(), d.copy()
    group = {i: frozenset([i]) for i in range(n)}
    splits, total = {}, 0.0
    while len(group) > 3:
        ids, r = sorted(group), len(group)
        s = {i: sum(d[i, j] for j in ids if j != i) for i in ids}
        a, b = min(((x, y) for x in ids for y in ids if y < x),
                   key=lambda p: (round((r - 2) * d[p] - s[p[0]] - s[p[1]], 6), p))
        la = 0.5 * (d[a, b] + (s[a] - s[b]) / (r - 2))
        lb = d[a, b] - la
        rest = [i for i in ids if i not in (a, b)]
        lam = 0.5 if v[a, b] == 0 else 0.5 + sum(v[b, i] - v[a, i] for i in rest) / (2 * (r - 2) * v[a, b])
        lam = min(1.0, max(0.0, lam))
        vab = v[a, b]
        for i in rest:
            d[a, i] = d[i, a] = lam * (d[a, i] - la) + (1 - lam) * (d[b, i] - lb)
            v[a, i] = v[i, a] = lam * v[a, i] + (1 - lam) * v[b, i] - lam * (1 - lam) * vab
        for g, length in ((group[a], la), (group[b], lb)):
            splits[g] = max(0.0, length)
        group[a] = group[a] | group.pop(b)
    x, y, z = sorted(group)
    for p, q, w in ((x, y, z), (y, x, z), (z, x, y)):
        splits[group[p]] = max(0.0, 0.5 * (d[p, q] + d[p, w] - d[q, w]))
    return splits


@pytest.mark.parametrize("leaves", [1000, 2])
def test_bionj_brute_force(spark, monkeypatch, leaves):
    """In one pass, and merge by merge as for large matrices."""
    monkeypatch.setattr(trees, "SMALL_LEAVES", leaves)
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for family, n in enumerate((4, 5, 7)):
        m = rng.uniform(0.1, 1.0, (n, n))
        m = (m + m.T) / 2
        np.fill_diagonal(m, 0)
        want[family] = plain_bionj(m)
        rows += [(family, i, j, float(m[i, j])) for i in range(n) for j in range(i + 1, n)]
    e = cut(trees.bionj(spark.createDataFrame(rows, "family bigint, i bigint, j bigint, d double")))
    below = trees.below(trees.closure(e)).join(e.select("family", "node", "length"), ["family", "node"])
    got = {}
    for r in below.groupBy("family", "node", "length").agg(F.collect_set("leaf_seq").alias("s")).collect():
        got.setdefault(r["family"], {})[frozenset(r["s"])] = r["length"]
    for family, splits in want.items():
        assert set(got[family]) == set(splits)
        for s, length in splits.items():
            assert got[family][s] == pytest.approx(length, abs=1e-9)


def test_bionj_small(spark):
    two = spark.createDataFrame([(0, 0, 1, 0.4), (1, 0, 1, 0.2), (1, 0, 2, 0.3), (1, 1, 2, 0.3)],
                                "family bigint, i bigint, j bigint, d double")
    e = trees.bionj(two)
    total = {r["family"]: r["tree_length"] for r in trees.tree_length(e).collect()}
    assert total[0] == pytest.approx(0.4)
    assert total[1] == pytest.approx(0.4)


def test_bionj_recovers_additive_tree(spark):
    full = X.edges(spark, SF).filter("tree_id = 0 and family = 3").drop("tree_id")
    few = spark.createDataFrame([(3, i) for i in (0, 3, 5, 8, 9, 14)], "family bigint, leaf_seq bigint")
    e = cut(trees.unroot(trees.prune(full, few)))
    again = cut(trees.bionj(trees.leaf_distances(e).select("family", "i", "j", "d")))
    a = trees.splits(e).select("family", "side", F.round("length", 6).alias("length"))
    b = trees.splits(again).select("family", "side", F.round("length", 6).alias("length"))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_trees_held_and_not_held_by_a_task_agree(spark, monkeypatch):
    from aligngrid.plans.counting import clean_sites

    e = cut(X.edges(spark, SF).filter("family < 4").withColumn("length", F.when(F.col("node") % 7 == 3, 0.0).otherwise(F.col("length"))))
    keep = e.filter("leaf_seq is not null and (leaf_seq * 5 + family) % 3 > 0").select("family", "leaf_seq").distinct()
    sites = cut(clean_sites(spark, SF).filter("family < 4 and seq_id <> 5"))

    def all_three():
        pruned = trees.prune(e, keep).select("tree_id", "family", "node", "parent", F.round("length", 9).alias("length"), "leaf_seq")
        chosen = trees.greedy_trim(e, 6).select("tree_id", "family", "leaf_seq", "round")
        changed = parsimony.changes(sites, e).select("tree_id", "family", "node", "block", "chg")
        return [sorted(map(tuple, x.collect()), key=repr) for x in (pruned, chosen, changed)]

    one = all_three()
    monkeypatch.setattr(trees, "SMALL_NODES", 3)
    monkeypatch.setattr(trees, "SMALL_LEAVES", 3)
    monkeypatch.setattr(parsimony, "SMALL_NODES", 3)
    assert one == all_three() and all(len(x) > 20 for x in one)


def test_a_long_ladder_is_pruned(spark):
    """20,000 leaves, each branching off one node further up: no table of ancestors is made."""
    n = 20_000
    inner = F.when(F.col("id") < n - 1, F.col("id") + n + 1)
    leaves = spark.range(n).select(F.lit(0).cast("long").alias("family"), F.col("id").alias("node"),
                                   F.least(F.col("id") + n, F.lit(2 * n - 2)).alias("parent"), F.lit(0.5).alias("length"), F.col("id").alias("leaf_seq"))
    nodes = spark.range(n - 2).select(F.lit(0).cast("long").alias("family"), (F.col("id") + n).alias("node"), inner.alias("parent"),
                                      F.lit(0.25).alias("length"), F.lit(None).cast("long").alias("leaf_seq"))
    keep = spark.createDataFrame([(0, 0), (0, n // 2), (0, n - 1)], "family bigint, leaf_seq bigint")
    got = {r["leaf_seq"]: (r["parent"], r["length"]) for r in trees.prune(leaves.unionByName(nodes), keep).collect()}
    assert got[0] == (n + n // 2, 0.5 + 0.25 * (n // 2)) and got[n // 2] == (n + n // 2, 0.5)
    assert got[n - 1] == (2 * n - 2, 0.5) and got[None] == (2 * n - 2, 0.25 * (n - 2 - n // 2)) and len(got) == 4


def test_fit_in_a_row_and_by_rounds_agree(spark, monkeypatch):
    from aligngrid.operators import clean

    sites, e = small_alignment(spark)
    names = ["HKY+4dG", "RY", "CodonM0.0.F1X4"]

    def run():
        out = ranking.fit_models(clean.clean(sites), e, models=names, rounds=3, partitions=4)
        return {r["name"]: r for r in out["fitted"].collect()}

    one = run()
    monkeypatch.setattr(fit, "LOCAL_CELLS", 0)
    two = run()
    assert set(one) == set(two) == set(names)
    for k in names:
        assert one[k]["lnl"] == pytest.approx(two[k]["lnl"], abs=1e-6) and one[k]["converged"] == two[k]["converged"]
        assert one[k]["x"] == pytest.approx(two[k]["x"], abs=1e-5)


def test_bootstrap_trees_brute_force(spark):
    seqs = ["ACGTACGTAACCGGTT", "ACGTACGAAACCGGTA", "ACCTACGAATCCGGTA", "TCCTACGAATCAGGTA", "TCCTACGATTCAGATA"]
    cells = cut(pairs.dna_cells(sites_of(spark, seqs)))
    got = pairs.pair_counts(resample.bootstrap_cells(cells, 3), 2, ("family", "rep")).collect()
    n = len(seqs[0])
    for r in got:
        want = 0
        for p in range(n):
            q = int(hashlib.md5(f"0-{r['rep']}-{p}-12345".encode()).hexdigest()[:15], 16) % n
            want += seqs[r["i"]][q] != seqs[r["j"]][q]
        assert r["n_diff"] == want and r["n_both"] == n
    assert len(got) == 3 * 10
    e = trees.bionj(pairs.poisson(pairs.pair_counts(resample.bootstrap_cells(cells, 3), 2, ("family", "rep")), 4))
    assert sorted((r["rep"], r["count"]) for r in e.groupBy("rep").count().collect()) == [(0, 7), (1, 7), (2, 7)]


def test_long_alignment_splits_into_blocks(spark):
    """One family much longer than a block: pair counts and joins do not depend on blocks."""
    rng = np.random.default_rng(1)
    a = rng.choice(list("ACGT-"), 9001)
    b = rng.choice(list("ACGT-"), 9001)
    sites = sites_of(spark, ["".join(a), "".join(b)])
    r = pairs.pair_counts(pairs.dna_cells(sites), 2).head()
    ok = (a != "-") & (b != "-")
    assert r["n_both"] == ok.sum() and r["n_diff"] == (ok & (a != b)).sum() and r["n_sites"] == 9001
    assert r["n_ts"] == sum(1 for x, y in zip(a, b) if {x, y} in ({"A", "G"}, {"C", "T"}))
    assert {x["seq"] for x in recode.join_sites(sites).collect()} == {"".join(a), "".join(b)}
    path = recode.profile_path(sites).groupBy("seq_id", "step").count().collect()
    want = {}
    for i, s in enumerate((a, b)):
        for x, y in zip(s, s[1:]):
            k = (i, ("D" if x == "-" else "M") + ("D" if y == "-" else "M"))
            want[k] = want.get(k, 0) + 1
    assert {(x["seq_id"], x["step"]): x["count"] for x in path} == want
    cols = sites.filter("seq_id = 0 and ch <> '-'").select("family", "pos")
    dense = {x["pos"]: x["new_pos"] for x in recode.dense_positions(cols).collect()}
    assert dense == {int(p): i for i, p in enumerate(np.flatnonzero(a != "-"))}


def test_distance_error_matches_curvature(spark):
    seqs = ["ACGTACGTAACCGGTTACGA" * 3, "ACGTGCGAAACCGGTAACGA" * 3]
    row = pairs.distance_se(pairs.ml_distance(pairs.pair_counts(pairs.dna_cells(sites_of(spark, seqs)), 2))).head()
    k, t = 2.5, row["t"]

    def lnl(x):
        e1, e2 = math.exp(-4 / (k + 2) * x), math.exp(-2 * (k + 1) / (k + 2) * x)
        same, ts, tv = .25 + .25 * e1 + .5 * e2, .25 + .25 * e1 - .5 * e2, .25 - .25 * e1
        n_ts, n_tv = row["n_ts"], row["n_diff"] - row["n_ts"]
        return (row["n_both"] - row["n_diff"]) * math.log(same) + n_ts * math.log(ts) + n_tv * math.log(tv)

    assert lnl(t) >= max(lnl(t * 0.99), lnl(t * 1.01))
    h = 1e-3
    assert row["se"] == pytest.approx((-(lnl(t + h) + lnl(t - h) - 2 * lnl(t)) / h ** 2) ** -0.5, rel=1e-2)


def test_newick_round_trip(spark):
    e = X.edges(spark, SF).filter("family < 3")
    text = newick.render(e, trees.closure(e), places=3)
    names = spark.createDataFrame([(f, i, str(i + 1)) for f in range(3) for i in range(16)], "family bigint, seq_id bigint, name string")
    back = cut(newick.with_leaf_seq(newick.parse_trees(text), names))
    a = trees.splits(e).select("tree_id", "family", "side", F.round("length", 3).alias("x"))
    b = trees.splits(back).select("tree_id", "family", "side", F.round("length", 3).alias("x"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert newick.rooted(back).filter("not is_rooted").count() == 0


def test_newick_defaults_and_labels(spark):
    text = spark.createDataFrame([(1, "((a,b:0.2#3),c:1e-3,d);")], "family bigint, newick string")
    rows = {r["name"]: r for r in newick.parse_trees(text).filter("name is not null").collect()}
    assert rows["a"]["length"] == 0.1 and rows["b"]["label"] == 3 and rows["c"]["length"] == 0.001
    assert not newick.leaf_names(spark.createDataFrame([(1, "(a,b,c,d);")], "family bigint, newick string")).head()["brackets_ok"]


def test_deep_tree(spark):
    """A comb of 40 leaves: the closure must reach the root."""
    rows = []
    for k in range(39):
        rows.append((0, 100 + k, 99 + k if k else 99, 1.0, None) if k else (0, 100, 99, 1.0, None))
        rows.append((0, k, 99 + k, 1.0, k))
    rows.append((0, 39, 138, 1.0, 39))
    e = spark.createDataFrame(rows, "family bigint, node bigint, parent bigint, length double, leaf_seq bigint")
    assert trees.closure(e).agg(F.max("hops")).head()[0] == 40


# ---- likelihood -------------------------------------------------------------------------------

def brute_lnl(seqs, parent, length, pi, q):
    """Sum over all inner states, site by site."""
    n = len(parent)
    inner = [x for x in range(n) if x >= len(seqs)]
    lam, u = np.linalg.eig(q)
    p = {b: (u @ np.diag(np.exp(lam * length[b])) @ np.linalg.inv(u)).real for b in range(n) if parent[b] is not None}
    total = 0.0
    for site in zip(*seqs):
        like = 0.0
        for states in itertools.product(range(4), repeat=len(inner)):
            at = dict(zip(inner, states))
            x = pi[at[n - 1]]
            for b in range(n - 1):
                s = at.get(b, None) if b >= len(seqs) else "ACGT".find(site[b])
                x *= 1.0 if s == -1 else p[b][at[parent[b]], s]
            like += x
        total += math.log(like)
    return total


SEQS = ["ACGTAC-TTA", "ACGTACGTTG", "ACTTACGCTA", "GCTTAC-CTA"]
PARENT, LENGTH = [4, 4, 5, 5, 5, None], [0.1, 0.3, 0.2, 0.5, 0.15, None]


def test_kernel_brute_force():
    states = np.array([["ACGT".find(c) for c in s] for s in SEQS])
    counts = np.ones(10)
    pi = np.array([0.4, 0.1, 0.2, 0.3])
    for core, own in (("JC", []), ("HKY", [3.0]), ("REV", [1.2, 3.0, 0.7, 0.9, 4.0])):
        par = dict(zip(kernel.own_parameters(core, False), own))
        lam, left, right = kernel.decompose(kernel.exchange(core, 4, par, None), pi)
        q = (left * lam) @ right
        assert -(pi * np.diag(q)).sum() == pytest.approx(1.0)
        x = np.log(LENGTH[:5] + own)
        moved = x.copy()
        moved[2] += 0.5
        got = kernel.block_lnl(core, False, 0, pi, None, [4, 4, 5, 5, 5, -1], [0, 1, 2, 3, -1, -1], states, counts, [x, moved])
        for vec, value in zip((x, moved), got):
            assert value == pytest.approx(brute_lnl(SEQS, PARENT, list(np.exp(vec[:5])), pi, q), abs=1e-8)


def small_alignment(spark):
    lead = "ATGGCTAAACGTGAAACCCTGTTCGGCAAA"
    seqs = [lead, lead[:9] + "CGC" + lead[12:], "ATGGCAAAACGTGAGACCCTGTTTGGCAAA", "ATGGCAAAGCGTGAGACTCTATTTGGAAAA", "ATGTCAAAGCGTGACACTCTATTTGGAAGA"]
    sites = sites_of(spark, seqs)
    e = spark.createDataFrame(
        [(0, i, 10 + (i > 1) + (i > 2), 0.1, i) for i in range(5)] + [(0, 10, 11, 0.1, None), (0, 11, 12, 0.1, None)],
        "family bigint, node bigint, parent bigint, length double, leaf_seq bigint")
    e = e.withColumn("parent", F.when(F.col("leaf_seq") == 4, 12).otherwise(F.col("parent")).cast("bigint"))
    return sites, e


def test_fit_reaches_an_optimum(spark):
    sites, e = small_alignment(spark)
    from aligngrid.operators import clean

    names = ["HKY", "JC+4dG", "EQU", "CodonM0.0.EQU"]
    out = ranking.fit_models(clean.clean(sites), e, models=names, rounds=12, partitions=8)
    rows = out["fitted"].collect()
    assert {r["name"] for r in rows} == set(names)
    blocks = {r["data_type"]: r for r in out["blocks"].filter("lane = 0").collect()}
    for r in rows:
        b = blocks[r["data_type"]]
        table = {c: i for i, c in enumerate(fit.SYMBOLS[r["data_type"]])}
        states = np.array([table.get(c, -1) for c in b["text"]]).reshape(len(b["counts"]), -1).T
        x, lo, hi = np.array(r["x"]), np.array(r["lo"]), np.array(r["hi"])
        nudged = [np.clip(x + h * one, lo, hi) for one in np.eye(len(x)) for h in (-0.05, 0.05)]
        v = kernel.block_lnl(r["core"], r["gamma"], 0, r["pi"], None, r["up"], r["leaf"], states, b["counts"], [x] + nudged)
        assert v[0] == pytest.approx(r["lnl"], abs=1e-6)
        assert max(v[1:]) <= v[0] + 0.01, r["name"]
    flat = fit.surface(out["fitted"], out["blocks"], "kappa").collect()
    top = max(flat, key=lambda r: r["lnl"])
    kappa = [r for r in fit.parameters(out["fitted"]).collect() if r["parameter"] == "kappa" and r["name"] == "HKY"][0]["value"]
    mine = sorted(r["value"] for r in flat if r["name"] == "HKY")
    assert len(mine) == 301 and mine[0] == 0.0 and top["lnl"] <= max(r["lnl"] for r in rows) + 1e-6
    best = max((r for r in flat if r["name"] == "HKY"), key=lambda r: r["lnl"])["value"]
    assert best == pytest.approx(kappa, rel=0.15)
    grid = fit.surface_2d(out["fitted"], out["blocks"], "kappa", "omega").collect()
    assert len(grid) == 256 and min(r["value1"] for r in grid) == min(r["value2"] for r in grid) == 0.0 and max(r["lnl"] for r in grid) <= max(r["lnl"] for r in rows if r["name"] == "CodonM0.0.EQU") + 0.05
    # the caller's grid, split over many rows: as many points as 300 x 300
    one = out["fitted"].filter("name = 'HKY'")
    wide = fit.grid(one, out["blocks"], [("kappa", 0.0, 0.01, 90_000)])
    seen = wide.agg(F.count("*"), F.min("value1"), F.max("value1"), F.max("lnl")).head()
    assert seen[0] == 90_000 and seen[1] == 0.0 and seen[2] == pytest.approx(899.99)
    assert seen[3] == pytest.approx([r["lnl"] for r in rows if r["name"] == "HKY"][0], abs=0.05)
    given = {r["value"]: r["lnl"] for r in fit.surface(out["fitted"].filter("name = 'HKY'"), out["blocks"], "kappa", (0.5, 2.5, 0.5)).collect()}
    assert sorted(given) == [0.5, 1.0, 1.5, 2.0, 2.5]
    path = new_path(spark, "params")
    sinks.write_parameters(fit.parameters(out["fitted"]), path)
    back = spark.read.json(path)
    assert back.count() == sum(len(r["x"]) for r in rows)


@pytest.mark.parametrize("states", ["ACGT", "RY"])
def test_levels_agree_with_blocks(spark, monkeypatch, states):
    """Joins level by level and blocks in numpy are two independent ways to the same likelihoods and vectors."""
    from aligngrid.plans import scoring

    prep = scoring.Prepared(spark, SF)
    prep.edges = prep.edges.filter("family < 4")
    classes = ((0, 0.3, 0.5), (1, 1.7, 0.5))
    pats, params = scoring.setup(prep, states)

    def both():
        site = likelihood.site_likelihood(pats, prep.edges, prep.sequences, params, states, classes).collect()
        parts = likelihood.partials(pats, prep.edges, prep.sequences, params, states, classes).collect()
        key = lambda r: (r["tree_id"], r["family"], r["class"], r["pattern_id"])
        return ({key(r): r["lnl"] for r in site},
                {(*key(r), r["node"]): [math.log10(max(r[f"l_{x}"], 1e-300)) - r["scale"] for x in states] for r in parts})

    one = both()
    monkeypatch.setattr(likelihood, "TREE_NODES", 10)
    two = both()
    for a, b in zip(one, two):
        assert set(a) == set(b) and len(a) > 100
        assert all(a[k] == pytest.approx(b[k], abs=1e-7) for k in a)


def test_positions_with_own_and_tied_sets(spark):
    """Own sets equal separate runs summed; tied sets equal the shared run."""
    from aligngrid.operators import partition
    from aligngrid.plans import scoring

    prep = scoring.Prepared(spark, SF)
    prep.sites = cut(prep.sites.filter("family < 4"))
    prep.edges = cut(prep.edges.filter("family < 4"))
    edges = prep.edges.withColumn("tree_set", F.explode(F.array(*map(F.lit, range(3))))).withColumn(
        "length", F.col("length") * (F.col("tree_set") + 1) / 2)
    freq = scoring.position_frequencies(prep.sites)

    def run(model_of, tree_of, classes=likelihood.ONE):
        params = partition.shared_frequencies(freq, model_of).withColumn("kappa", 1.0 + F.col("model_set"))
        out = partition.own_likelihood(prep.sites, edges, params, model_of, tree_of, classes=classes)
        return {(r["tree_id"], r["family"]): r["lnl"] for r in out.collect()}

    alone = [run({p: p}, {p: p}) for p in range(3)]
    own = run({0: 0, 1: 1, 2: 2}, {0: 0, 1: 1, 2: 2})
    assert own.keys() == alone[0].keys() and all(own[k] == pytest.approx(sum(x[k] for x in alone), abs=1e-7) for k in own)
    tied = run({0: 0, 1: 0, 2: 0}, {0: 1, 1: 1, 2: 1})
    params = partition.shared_frequencies(freq, {0: 0, 1: 0, 2: 0}).withColumn("kappa", F.lit(1.0))
    pats = A.patterns(prep.sites)
    site = likelihood.site_likelihood(pats, prep.edges, prep.sequences, params, "ACGT")
    shared = {(r["tree_id"], r["family"]): r["lnl"] for r in likelihood.total(site, pats).collect()}
    assert tied.keys() == shared.keys() and all(tied[k] == pytest.approx(shared[k], abs=1e-7) for k in tied)
    mixed = run({0: 0, 1: 0, 2: 0}, {0: 1, 1: 1, 2: 1}, ((0, 1.0, 0.5), (1, 1.0, 0.5)))
    assert all(mixed[k] == pytest.approx(tied[k], abs=1e-7) for k in tied)


@pytest.mark.parametrize("chunk", [3, 4096])
def test_model_distances(spark, chunk):
    """EQU against its closed form, a codon model with unequal frequencies against P(t) from the matrix itself."""
    from aligngrid.operators import distance

    rng = np.random.default_rng(8)
    n = 61
    pi = rng.dirichlet(np.ones(n) * 4)
    q = np.zeros((n, n))
    for i, j, ts, a1, a2, _ in models.codon_steps():
        q[i, j] = (2.0 if ts else 1.0) * (0.3 if a1 != a2 else 1.0) * pi[j]
    q /= pi @ q.sum(1)
    q -= np.diag(q.sum(1))
    seqs = rng.integers(0, n, (5, 150))
    seqs[:, :110] = seqs[0, :110]
    lead = rng.random((5, 150))
    seqs = [[None if x < 0.05 else int(s) for s, x in zip(a, b)] for a, b in zip(seqs, lead)]
    seqs[4] = [None] * 149 + [3]
    seqs[3][149] = None
    rows = [(0, i, p, s) for i, a in enumerate(seqs) for p, s in enumerate(a)]
    cells = spark.createDataFrame(rows, "family bigint, seq_id bigint, pos bigint, state int")
    qf = spark.createDataFrame([(0, i, j, float(q[i, j])) for i in range(n) for j in range(n) if q[i, j]],
                               "family bigint, i int, j int, q double")
    pf = spark.createDataFrame([(0, i, float(p)) for i, p in enumerate(pi)], "family bigint, state int, pi double")
    forms = distance.eigen_forms(qf, pf, ["family"])
    got = {(r["i"], r["j"]): r for r in distance.model_distance(cells, n, forms, chunk=chunk).collect()}
    assert len(got) == 10 and got[(3, 4)]["t"] == 20.0 and got[(3, 4)]["lnl"] is None
    term, powers = np.eye(n), [np.eye(n)]
    for k in range(1, 30):
        term = term @ (q / 64) / k
        powers.append(term)

    def lnl(a, b, t):
        p = np.linalg.matrix_power(sum(x * t**k for k, x in enumerate(powers)), 64)
        return sum(math.log(p[x, y]) for x, y in zip(seqs[a], seqs[b]) if x is not None and y is not None)

    for (a, b), r in got.items():
        if r["n_both"] > 20:
            near = [lnl(a, b, max(r["t"] + h, 1e-5)) for h in (-0.002, 0.0, 0.002)]
            assert near[1] >= max(near[0], near[2]) - 1e-9, (a, b, r["t"])
    flat = np.full((20, 20), 1 / 19.0)
    np.fill_diagonal(flat, -1.0)
    qa = spark.createDataFrame([(0, i, j, float(flat[i, j])) for i in range(20) for j in range(20)], "family bigint, i int, j int, q double")
    pa_ = spark.createDataFrame([(0, i, 0.05) for i in range(20)], "family bigint, state int, pi double")
    aa = cells.withColumn("state", F.col("state") % 20)
    got = {(r["i"], r["j"]): r["t"] for r in distance.model_distance(aa, 20, distance.eigen_forms(qa, pa_, ["family"]), chunk=chunk).collect()}
    want = {(r["i"], r["j"]): r["d"] for r in pairs.poisson(pairs.pair_counts(aa, 5), 20).collect()}
    for k, d in want.items():
        assert got[k] == pytest.approx(min(max(d, 1e-5), 10.0) if d < 20 else got[k], abs=1e-4)


def test_result_files_keep_what_is_incomplete(spark):
    fits = spark.createDataFrame([(0, 1, "RY+4dG", "RY", 1.5, -10.0, 4, True, None), (0, 20, "WAG", "AA", None, None, 2, None, "no matrix given"),
                                  (1, 2, "JC", "DNA", 0.5, -20.0, 0, False, None)],
                                 "family bigint, model_no int, name string, data_type string, tree_length double, ori_lnl double, k int, "
                                 "converged boolean, reason string")
    none = spark.createDataFrame([], "family bigint, data_type string, adjust double")
    path = new_path(spark, "results")
    sinks.write_results(rank.delta(rank.results(fits, none)), path)
    got = sinks.read_results(spark, path)
    assert got.columns == [*sinks.HEADER, "Converged", "Reason", "family"]
    assert [(r["Model#"], r["Converged"], r["Reason"], r["OrilnL"]) for r in got.orderBy("family", "NoPar").collect()] == [
        ("Model[20]", None, "no matrix given", None), ("Model[1]", True, None, -10.0), ("Model[2]", False, None, -20.0)]


def test_gamma_classes(spark):
    # published class rates at alpha 0.5
    assert models.gamma_rates(0.5) == pytest.approx((0.03339, 0.25192, 0.82027, 2.89443), abs=5e-6)
    for a in (0.05, 0.3, 1.0, 7.0, 60.0):
        r = models.gamma_rates(a)
        assert sum(r) / 4 == pytest.approx(1.0, abs=1e-9) and list(r) == sorted(r)
    assert models.gamma_rates(100.0) == (1.0,) * 4
    # alpha 1 is exponential: class means have a closed form
    q = [0] + [-math.log(1 - k / 4) for k in (1, 2, 3)]
    mean = [4 * ((x + 1) * math.exp(-x) - ((y + 1) * math.exp(-y) if y is not None else 0)) for x, y in zip(q, q[1:] + [None])]
    assert models.gamma_rates(1.0) == pytest.approx(mean, abs=1e-9)


def test_eigen_and_closed_form(spark):
    params = spark.createDataFrame([(0, 0.4, 0.1, 0.2, 0.3, 2.5)], "family bigint, pi_A double, pi_C double, pi_G double, pi_T double, kappa double")
    times = spark.createDataFrame([(0, t) for t in (0.0, 1e-5, 0.01, 0.5, 3.0, 11.0)], "family bigint, t double")
    closed = models.pt_closed(times.join(params, "family"), ["family"])
    pi = spark.createDataFrame([(0, i, p) for i, p in enumerate((0.4, 0.1, 0.2, 0.3))], "family bigint, state int, pi double")
    ex = models.dna_exchange(params.select("family", "kappa")).filter("model = 'HKY'").select("family", "i", "j", "s")
    q = models.scale(models.q_matrix(ex, pi, ["family"]), pi, ["family"])
    assert models.reversible(q, pi, ["family"]).head()["balanced"]
    eigen = models.pt_eigen(q, pi, times, ["family"]).select("family", "t", "i", F.posexplode("p").alias("j", "p2"))
    both = closed.join(eigen, ["family", "t", "i", "j"])
    assert both.count() == 6 * 16
    assert both.agg(F.max(F.abs(F.col("p") - F.col("p2")))).head()[0] < 1e-9
    assert closed.groupBy("t", "i").agg(F.sum("p").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0


def test_counts_add_up(spark):
    codons = cut(cleaned(spark, SF))
    sites = recode.codon_sites(codons)
    assert A.patterns(sites).agg(F.sum("n")).head()[0] == sites.select("family", "pos").distinct().count()
    by_type = {r["data_type"]: r["n"] for r in fit.all_patterns(codons).groupBy("data_type").agg(F.sum("n").alias("n")).collect()}
    assert by_type["DNA"] == by_type["RY"] == 3 * by_type["AA"] == 3 * by_type["CodonReduced"]
    boot = resample.bootstrap(A.site_pattern(A.columns(sites), A.patterns(sites)), 2)
    assert boot.groupBy("family", "rep").agg(F.sum("n").alias("n")).filter("n <> 120").count() == 0


def test_parsimony_two_sequences(spark):
    e = spark.createDataFrame([(0, 1, 0, .1, 0), (0, 2, 0, .1, 1)], "family bigint, node bigint, parent bigint, length double, leaf_seq bigint")
    s = sites_of(spark, ["ACGT-A", "ACCTTG"])
    assert parsimony.score(parsimony.changes(s, e, trees.closure(e))).head()["score"] == 2


def test_top_trees_ties_follow_the_seed(spark):
    rows = spark.createDataFrame([(0, t, 0, 1) for t in range(50)], "family bigint, tree_id int, node int, score int")
    one = rank.top_trees(rows, 5, 1).collect()
    assert one == rank.top_trees(rows, 5, 1).collect()
    assert {r["tree_id"] for r in one} != {r["tree_id"] for r in rank.top_trees(rows, 5, 2).collect()}


def test_whole_run_without_tree(spark):
    sites = X.sites(spark, SF).filter("family < 2")
    out = ranking.rank_models(sites, models=["RY", "JC", "HKY"], mode="fast", trim_to=6)
    rows = out.collect()
    assert len(rows) == 6 and all(r["delta_aic"] >= 0 for r in rows)


# ---- files ---------------------------------------------------------------------------------------

def parse(spark, text):
    lines = [x for x in text.split("\n") if x.strip()]
    return alignments.parse_alignments(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "path string, idx bigint, line string"))


@pytest.mark.parametrize("text", [
    "2 6\n\na\tacgTAC\n\nb\tGG-TAA\n", " 2   6\nname1\nACG\nTAC\nname2\nGG-\nTAA\n".replace("name1", "a").replace("name2", "b"),
    "2 6\na  ACG\nb  GG-\n\nTAC\nTAA\n", "2 6\na AC GTAC\nb GG -TAA\n"])
def test_layouts(spark, text):
    got = {r["name"]: r["seq"] for r in parse(spark, text).collect()}
    assert got == {"a": "ACGTAC", "b": "GG-TAA"}


def test_wrong_length_raises(spark):
    with pytest.raises(Exception, match="wrong sequence length"):
        parse(spark, "2 6\na ACG\nb GG-TAA\n").collect()


def test_lines_keep_file_order(spark):
    path = new_path(spark, "lines")
    spark.range(1000).repartition(1).sortWithinPartitions("id").select(F.col("id").cast("string").alias("value")).write.text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        from aligngrid.sources.lines import read_lines

        assert read_lines(spark, path).filter("idx <> cast(line as bigint)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_manifest_errors(spark):
    for body, message in (("GENES\nx\n", "no MULTIGENE"), ("MULTIGENE\nx y\n", "more than one word")):
        path = new_path(spark, "manifest")
        spark.createDataFrame([(body.rstrip(),)], "value string").write.text(path)
        with pytest.raises(Exception, match=message):
            alignments.read_manifest(spark, path).collect()


def test_switches(spark):
    home = "[Amino Acid]\nrtREV=0\n[Codon]\nF0=off\nF64 = maybe ; note"
    cwd = "; comment\n[amino acid]\nRTREV=yes\n[codon]\nf64: 0"
    rows = [(layer, i, x) for layer, t in (("home", home), ("cwd", cwd)) for i, x in enumerate(t.split("\n"))]
    df = spark.createDataFrame(rows, "layer string, idx bigint, line string")
    got = {(r["section"], r["switch"]): r["is_on"] for r in settings.resolve_switches(settings.parse_switches(df)).collect()}
    assert got == {("amino acid", "rtrev"): True, ("codon", "f0"): False, ("codon", "f64"): False}
    bad = spark.createDataFrame([("cwd", 0, "[x]"), ("cwd", 1, "no assignment")], "layer string, idx bigint, line string")
    with pytest.raises(Exception, match="cannot read switch line"):
        settings.parse_switches(bad).collect()


def test_matrix_file(spark):
    rng = np.random.default_rng(3)
    s = rng.uniform(0.1, 2, 190).round(4)
    pi = rng.dirichlet(np.ones(20)).round(6)
    rows, k = [], 0
    for i in range(1, 20):
        rows.append(" ".join(map(str, s[k:k + i])))
        k += i
    text = "\n".join(rows + [" ".join(map(str, pi)), "A R N D C Q E G H I L K M F P S T W Y V"])
    path = new_path(spark, "matrix")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    m = settings.read_matrices(spark, path).head()
    assert m["s"] == pytest.approx(list(s)) and sum(m["pi"]) == pytest.approx(1.0)
    # a matrix named like a catalogue model puts that model into the ranking
    sites, e = small_alignment(spark)
    mats = settings.read_matrices(spark, path).withColumn("model", F.lit("WAG"))
    res = ranking.rank_models(sites, e, matrices=mats, models=["WAG", "WAG+F", "EQU"], mode="fast").collect()
    assert {r["name"] for r in res} == {"WAG", "WAG+F", "EQU"}


def test_refuses_to_overwrite(spark):
    path = new_path(spark, "out")
    seqs = spark.createDataFrame([(0, 0, "a", "ACG")], "family bigint, seq_id bigint, name string, seq string")
    alignments.write_sequential(seqs, path)
    with pytest.raises(Exception, match="(?i)already exists"):
        alignments.write_sequential(seqs, path)


def test_studies_list_every_gene(spark):
    m = files.manifest_files(spark, SF)
    assert m.count() == X.family_sizes(spark, SF).count()


def test_slopes_match_differences():
    """Slope and curvature of every branch from two passes, against steps of the likelihood; a 62-state code too."""
    rng = np.random.default_rng(4)
    up, leaf = [5, 5, 6, 7, 7, 6, 7, -1], [0, 1, 2, 3, 4, -1, -1, -1]
    for core, k, gamma, code, own in (("HKY", 4, True, 0, [2.5, 0.6]), ("M0", 62, False, 4, [2.0, 0.3]), ("M0", 60, True, 1, [3.0, 0.2, 0.9])):
        assert core != "M0" or k == len(catalog.sense_codons(code))
        pi = rng.dirichlet(np.ones(k) * 5)
        states, counts = rng.integers(-1, k, (5, 7)), rng.integers(1, 5, 7)
        block = kernel.Block(core, gamma, code, pi, None, up, leaf, states, counts)
        x = np.log(np.concatenate([rng.uniform(0.05, 0.8, 7), own]))
        got = block.slopes(x, 0.01)
        assert len(got) == 1 + 14 + 2 * (len(own) + 1)
        assert got[0] == pytest.approx(block.lnl(x), abs=1e-9)
        for b, h in itertools.product(range(7), [1e-4]):
            one = np.eye(len(x))[b] * h
            a, c = block.lnl(x + one), block.lnl(x - one)
            assert got[1 + b] == pytest.approx((a - c) / (2 * h), rel=1e-4, abs=1e-5)
            assert got[8 + b] == pytest.approx((a + c - 2 * got[0]) / (h * h), rel=1e-2, abs=2e-2)


def test_codon_likelihood_of_other_codes():
    """60 and 62 sense codons: the kernel against P(t) from the matrix itself."""
    def expm(m):  # by squaring of a Taylor series
        out = term = np.eye(len(m))
        for i in range(1, 25):
            term = term @ (m / 1024) / i
            out = out + term
        return np.linalg.matrix_power(out, 1024)

    for code in (1, 4):
        sense = catalog.sense_codons(code)
        aa = {c: a for _, c, _, a, _ in catalog.code_rows([code])}
        k = len(sense)
        pi = np.random.default_rng(code).dirichlet(np.ones(k) * 9)
        q = np.zeros((k, k))
        for (i, a), (j, b) in itertools.permutations(enumerate(sense), 2):
            diff = [(x, y) for x, y in zip(a, b) if x != y]
            if len(diff) == 1:
                ts = set(diff[0]) in ({"A", "G"}, {"C", "T"})
                q[i, j] = (2.0 if ts else 1.0) * (0.3 if aa[a] != aa[b] else 1.0) * pi[j]
        q -= np.diag(q.sum(1))
        q /= -(pi @ np.diag(q))
        p = expm(q * 0.7)
        states = np.array([[0, 5, k - 1, 7], [0, 9, k - 2, -1]])
        want = sum(math.log(pi[a] * (p[a, b] if b >= 0 else 1.0)) for a, b in states.T)
        # two leaves on one root: the branches add up
        got = kernel.block_lnl("M0", False, code, pi, None, [2, 2, -1], [0, 1, -1], states, np.ones(4), [np.log([0.3, 0.4, 2.0, 0.3])])
        assert got[0] == pytest.approx(want, abs=1e-8)
