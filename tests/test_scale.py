"""What a task holds, and how many files there are, must not grow with the tables. Rows are made here."""

from __future__ import annotations

import pathlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aligngrid import catalog
from aligngrid.functions import scalar
from aligngrid.operators import aggregate, clean, distance, kernel, likelihood, pairs, partition, recode, resample, trees
from aligngrid.plans import files, recoding
from aligngrid.plans import fixtures as X
from aligngrid.session import shared_dir, spread
from aligngrid.sources import lines


@pytest.fixture
def sf(spark, tmp_path):
    """320 documents: 20 families."""
    rows = [(i, " ".join(f"w{(i * 31 + k * 7) % 997}" for k in range(60 + i % 50))) for i in range(320)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def data_files(folder: pathlib.Path) -> int:
    return sum(1 for p in folder.rglob("part-*") if p.suffix != ".crc")


@pytest.mark.parametrize("name, query", [("switches", files.src_switches), ("models", files.src_model_file)])
def test_files_of_many_families_are_bundled(spark, sf, name, query):
    """a file a family and layer was written, 20 or 40 here."""
    shared = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.glob(f"{name}-*"))
    got = query(spark, sf)
    assert got.select("family").distinct().count() == 20
    (made,) = set(shared.glob(f"{name}-*")) - before
    assert 0 < data_files(made) < 20


def test_bundled_lines_are_those_of_files(spark, tmp_path):
    texts = {"a": "; note\n\n[Codon]\r\n x = 1 \n", "b": "y = 0", "c": "", "d": "z = 2\n\n"}
    lines.write_bundles(spark.createDataFrame(list(texts.items()), "path string, text string").coalesce(2), f"{tmp_path}/bundles")
    for name, text in texts.items():
        (tmp_path / "plain").mkdir(exist_ok=True)
        (tmp_path / "plain" / name).write_text(text)
    plain = lines.read_lines(spark, f"{tmp_path}/plain").withColumn("path", F.substring_index("path", "/", -1))
    got = lines.lines_of(lines.read_bundles(spark, f"{tmp_path}/bundles"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_partitions_of_fixtures_grow_with_the_documents(spark, sf, monkeypatch):
    """small tables that are multiplied later came in one partition."""
    monkeypatch.setattr(X, "DOCUMENTS", 32)
    monkeypatch.setattr(X, "TREE_DOCUMENTS", 64)
    assert X.codons(spark, sf).rdd.getNumPartitions() == 10
    assert recoding.cleaned(spark, sf).rdd.getNumPartitions() == 10
    assert X.edges(spark, sf).rdd.getNumPartitions() == 5


def test_sequences_judged_in_place(spark):
    rows = [(f, s, c, "---" if (c + (s or 0)) % 5 > (s or 0) else "ACG") for f in (0, 1, None) for s in (0, 2, 3, None) for c in range(10)]
    codons = spark.createDataFrame(rows + rows[:15], "family bigint, seq_id bigint, cpos bigint, codon string")
    want = clean.clean_made(codons, share=0.5)
    got = clean.clean_made(codons.repartition(3, "family"), share=0.5, in_place=True)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.count() > 0


def test_spread(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 50)
    assert spread(df, 100, "k").rdd.getNumPartitions() == 10
    assert spread(df.filter("id < 0"), 100, "k").rdd.getNumPartitions() == 1


def test_replicates_are_dealt_out(spark, monkeypatch):
    """All replicates of small tables were made in one partition."""
    monkeypatch.setattr(resample, "DRAWS", 100)
    monkeypatch.setattr(resample, "COLUMNS", 10)
    rows = [(f, s, p, (s * p + f) % 4) for f in range(4) for s in range(3) for p in range(10)]
    cells = spark.createDataFrame(rows, "family bigint, seq_id bigint, pos bigint, state int")
    got = resample.bootstrap_cells(cells, 5)
    assert got.rdd.getNumPartitions() == 2
    assert got.count() == 4 * 3 * 10 * 5
    assert resample.draws(spread(cells.select("family", "pos").distinct(), 10, "family"), 5).rdd.getNumPartitions() == 4


def test_likelihoods_work_on_slices(monkeypatch):
    """a batch of 10,000 blocks was held with all that was made of it."""
    batch = pa.RecordBatch.from_pydict({"a": list(range(1000)), "b": [[k, k + 1] for k in range(1000)]})
    parts = list(likelihood._slices(iter([batch, batch])))
    assert max(p.num_rows for p in parts) == likelihood.SLICE and sum(p.num_rows for p in parts) == 2000
    assert [list(v) for v in likelihood._cells(parts[1].column(1))] == [[64 + k, 65 + k] for k in range(64)]


def test_distances_searched_together():
    """each pair was searched by itself. Flat and equal likelihoods, one code and many."""
    rng = np.random.default_rng(3)
    k = 5
    s = rng.random((k, k))
    pi = rng.dirichlet(np.ones(k))
    q = (s + s.T) * pi
    np.fill_diagonal(q, 0.0)
    np.fill_diagonal(q, -q.sum(1))
    form = np.concatenate([x.ravel() for x in distance.decomposed(q, pi)])
    codes = [np.sort(rng.choice(k * k, size, replace=False)) for size in (1, 3, 9, 25, 2, 7)]
    counts = [rng.integers(1, 50, len(c)) for c in codes]
    t, lnl = distance.best_distances(codes, counts, form, together=4)
    for c, n, a, b in zip(codes, counts, t, lnl):
        assert (a, b) == pytest.approx(distance.best_distance(c, n, form), rel=1e-9, abs=1e-9)


def test_letters_of_texts(spark):
    """every letter was looked up by itself, six times. Null, empty and wide characters; a column cut in the middle."""
    texts = [None, "", "ACGTN", "nN", "aÄc€😀g", "hello world", "NNA", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    for df in (rows, rows.filter("i = 4"), rows.filter("i < 2")):
        for alphabet in (catalog.DNA, catalog.AA):
            for r in df.select("t", scalar.type_score("t", alphabet).alias("x")).collect():
                kept = [c for c in r.t or "" if c not in "Nn"]
                want = sum(c in alphabet + alphabet.lower() for c in kept) / len(kept) if kept else -1.0
                assert r.x == want
    assert spark.range(0).select(scalar.type_score(F.lit("A"), catalog.DNA)).collect() == []
    assert "translate" not in rows.select(scalar.guess_type("t"))._jdf.queryExecution().toString()


def random_tree(rng, leaves: int):
    """node, parent, rank of the leaf or -1: children joined at random, two or three at a time, in any order of ids."""
    ids = list(rng.permutation(3 * leaves))
    rank = {int(n): r for r, n in enumerate(ids[:leaves])}
    open_, parent, new = list(rank), {}, leaves
    while len(open_) > 1:
        some = [open_.pop(int(rng.integers(len(open_)))) for _ in range(min(len(open_), int(rng.integers(2, 4))))]
        parent |= {n: int(ids[new]) for n in some}
        open_.append(int(ids[new]))
        new += 1
    nodes = [int(n) for n in rng.permutation(list(parent))]
    return np.array(nodes), np.array([parent[n] for n in nodes]), np.array([rank.get(n, -1) for n in nodes])


@pytest.mark.parametrize("k, wide, scale", [(4, 7, 1.0), (4, 3, 1.0), (2, 9, 1.0), (4, 6, 30.0)])
def test_blocks_pruned_together(k, wide, scale):
    """Each block was pruned by itself. Trees of other shapes and sizes, many leaves with long branches."""
    rng = np.random.default_rng(k + wide)
    trees = [random_tree(rng, n) for n in (2, 3, 5, 16, 150)]
    sizes = [wide - r % 3 for r in range(len(trees))]
    shown = [rng.integers(-1, k, size=(int((t[2] >= 0).sum()), m)) for t, m in zip(trees, sizes)]
    pi, s = rng.dirichlet(np.ones(k) * 5, size=len(trees)), np.ones((len(trees), k, k))
    length = [np.minimum(rng.random(len(t[0])) * scale, catalog.MAX_BRANCH) for t in trees]
    first = np.cumsum([0] + [len(x) for x in shown])
    cols = np.full((first[-1], max(sizes)), k)
    for r, x in enumerate(shown):
        cols[first[r]:first[r + 1], :sizes[r]] = np.where(x < 0, k, x)
    tree = np.repeat(np.arange(len(trees)), [len(t[0]) for t in trees])
    rank = np.concatenate([t[2] for t in trees])
    up, roots = kernel.forest_places(tree, np.concatenate([t[0] for t in trees]), np.concatenate([t[1] for t in trees]))
    forest = kernel.Forest(tree, up, np.where(rank >= 0, rank + first[tree], -1), cols, k)
    rates = np.array([0.3, 1.0, 2.5])
    *_, (_, v, scales) = forest.upwards(kernel.decompositions(s, pi), np.concatenate(length)[:, None] * rates)
    got = np.log(np.einsum("rk,rcmk->rcm", pi, v)) + scales[:, None]
    for r, (node, parent, leaf) in enumerate(trees):
        order, ids, above = kernel.ordered_tree(node, parent)
        assert ids[-1] == roots[r]
        block = kernel.Block("EQU", False, 0, pi[r], None, above, np.append(leaf[order], -1), shown[r], np.ones(sizes[r]))
        want = block.class_lnl(np.log(length[r][order]), rates)
        assert np.allclose(got[r, :, :sizes[r]], want, rtol=1e-9, atol=1e-9)


def test_trees_that_are_none():
    with pytest.raises(ValueError):
        kernel.forest_places(np.array([0, 0]), np.array([1, 2]), np.array([0, 3]))
    with pytest.raises(ValueError):
        kernel._depths(np.array([1, 0]))


def test_blocks_dealt_out(spark, monkeypatch):
    """The rows that are pruned came in as many partitions as their few bytes asked for."""
    monkeypatch.setattr(likelihood, "TASK_BLOCKS", 2)
    edges = spark.createDataFrame([(t, f, n, 0, 0.1, n) for t in (0, 1) for f in range(6) for n in (1, 2)],
                                  "tree_id int, family bigint, node bigint, parent bigint, length double, leaf_seq bigint")
    pats = spark.createDataFrame([(f, p, 0) for f in range(6) for p in ("AC",)], "family bigint, pattern string, pattern_id bigint")
    params = spark.createDataFrame([(f, 0.25, 0.25, 0.25, 0.25, 1.0) for f in range(6)],
                                   "family bigint, pi_A double, pi_C double, pi_G double, pi_T double, kappa double")
    out = likelihood.site_likelihood(pats, edges, edges.select("family", F.col("leaf_seq").alias("seq_id")), params, "ACGT")
    assert out.rdd.getNumPartitions() == 6 and out.count() == 12


def test_columns_of_codons(spark):
    """Columns were made from a row a site, for each use anew."""
    rows = [(f, s, c, "".join("ACGT-"[(s * c + k * (f or 0) + c) % 5] for k in range(3))) for f in (0, 1, None) for s in (3, 1, 2) for c in range(7)]
    codons = spark.createDataFrame(rows, "family bigint, seq_id bigint, cpos bigint, codon string")
    sites = recode.codon_sites(codons)
    want, got = aggregate.columns(sites), aggregate.codon_columns(codons)
    order = sorted(want.columns)
    assert sorted(map(str, got.select(order).collect())) == sorted(map(str, want.select(order).collect()))
    freq = spark.createDataFrame([(f, 0, 0.1, 0.2, 0.3, 0.4, 2.0) for f in (0, 1)],
                                 "family bigint, model_set int, pi_A double, pi_C double, pi_G double, pi_T double, kappa double")
    edges = spark.createDataFrame([(0, t, f, n, 0, 0.1 * n, n) for t in (0, 1) for f in (0, 1) for n in (1, 2, 3)],
                                  "tree_id int, tree_set int, family bigint, node bigint, parent bigint, length double, leaf_seq bigint")
    run = lambda **given: [r["lnl"] for r in partition.own_likelihood(
        sites, edges, freq, {0: 0, 2: 0}, {0: 0, 2: 1}, **given).orderBy("family").collect()]
    assert run() == pytest.approx(run(cols=got, sequences=sites.select("family", "seq_id").distinct()))


@pytest.mark.parametrize("core, k, gamma", [("HKY", 4, False), ("HKY", 4, True), ("REV", 4, True), ("EQU", 20, False), ("M0", 61, False)])
def test_searches_side_by_side(monkeypatch, core, k, gamma):
    """candidates of a search and points of a surface were pruned one by one."""
    monkeypatch.setattr(kernel, "TOGETHER", 1 << 12)
    rng = np.random.default_rng(k)
    blocks, xs = [], []
    for n, m in ((3, 5), (6, 9), (4, 2)):
        node, parent, rank = random_tree(rng, n)
        order, _, up = kernel.ordered_tree(node, parent)
        states = rng.integers(-1, k, size=(n, m))
        blocks.append(kernel.Block(core, gamma, 0, rng.dirichlet(np.ones(k) * 20), None, up, np.append(rank[order], -1), states,
                                   rng.integers(1, 4, m)))
        xs.append(np.concatenate([np.log(rng.random(len(node)) + 0.05), rng.normal(size=len(kernel.own_parameters(core, gamma))) / 4]))
    cands = [[x + rng.normal(size=len(x)) / 5 for _ in range(j + 1)] for j, x in enumerate(xs)]
    for b, own, got in zip(blocks, cands, kernel.together_lnl(blocks, cands)):
        assert got == pytest.approx([b.lnl(x) for x in own], rel=1e-9)
    bounds = [np.full(len(x), -7.0) for x in xs], [np.full(len(x), 4.0) for x in xs]
    calls = []
    plain = kernel.Block.lnl
    monkeypatch.setattr(kernel.Block, "lnl", lambda self, x: calls.append(1) or plain(self, x))
    rounds = 2 if k == 61 else 4
    whole = kernel.climbs(blocks, xs, *bounds, rounds, 1e-3)
    assert not calls
    for b, x, lo, hi, got in zip(blocks, xs, *bounds, whole):
        alone = kernel.climb(b, x, lo, hi, rounds, 1e-3)
        assert got[2] == pytest.approx(alone[2], rel=1e-6) and got[2] == pytest.approx(plain(b, np.array(got[0])), rel=1e-9)


@pytest.mark.parametrize("core, k", [("HKY", 4), ("M0", 61)])
def test_candidates_are_pruned_once(monkeypatch, core, k):
    """the point a round starts from was pruned again, as were equal steps of the first round."""
    rng = np.random.default_rng(5)
    node, parent, rank = random_tree(rng, 5)
    order, _, up = kernel.ordered_tree(node, parent)
    block = kernel.Block(core, True, 0, rng.dirichlet(np.ones(k) * 20), None, up, np.append(rank[order], -1),
                         rng.integers(-1, k, size=(5, 6)), rng.integers(1, 4, 6))
    x = np.concatenate([np.log(rng.random(len(node)) + 0.05), rng.normal(size=len(block.names)) / 4])
    seen, plain = [], kernel.together_lnl

    def counted(blocks, cands):
        seen.extend(c.tobytes() for own in cands for c in own)
        return plain(blocks, cands)

    monkeypatch.setattr(kernel, "together_lnl", counted)
    bounds = np.full(len(x), -7.0), np.full(len(x), 4.0)
    got = kernel.climb(block, x, *bounds, 2, 0.0)
    assert len(seen) == len(set(seen))
    assert got[2] == pytest.approx(block.lnl(np.array(got[0])), rel=1e-9)


@pytest.mark.parametrize("even", [True, False])
def test_a_tree_is_one_product(monkeypatch, even):
    """a product of matrices was made for each node. Trees with two children everywhere and others."""
    rng = np.random.default_rng(6)
    blocks, xs = [], []
    for n in (4, 8):
        node, parent = np.arange(1, 2 * n - 1), (np.arange(1, 2 * n - 1) - 1) // 2
        rank = np.where(node >= n - 1, node - (n - 1), -1)
        if not even:
            node, parent, rank = random_tree(rng, n)
        order, _, up = kernel.ordered_tree(node, parent)
        blocks.append(kernel.Block("EQU", True, 0, rng.dirichlet(np.ones(20) * 9), None, up, np.append(rank[order], -1),
                                   rng.integers(-1, 20, size=(n, 5)), np.ones(5)))
        xs.append([np.append(np.log(rng.random(len(node)) + 0.05), a) for a in (-0.5, 0.5, 0.5)])
    calls, plain = [], kernel._by_tree
    monkeypatch.setattr(kernel, "_by_tree", lambda *a: calls.append(1) or plain(*a))
    for b, own, got in zip(blocks, xs, kernel.together_lnl(blocks, xs)):
        assert got == pytest.approx([b.lnl(x) for x in own], rel=1e-9)
    assert calls


def test_profile_is_whole(spark, tmp_path):
    """13 points between 0.5 and 3.5, where a profile runs from 0 to 1.5 max(1, v) in steps of max(1, v) / 200."""
    rows = [(i, " ".join(f"w{(i * 31 + k * 7) % 997}" for k in range(60 + i))) for i in range(32)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kappa = {r.family: r.kappa for r in aggregate.kappa_from_columns(
        recode.codon_sites(recoding.cleaned(spark, str(tmp_path)))).collect()}
    got = files.lnl_surface_1d(spark, str(tmp_path)).groupBy("tree_id", "family").agg(
        F.sort_array(F.collect_list("value")).alias("values"), F.count("lnl").alias("n")).collect()
    assert len(got) == 4 and set(kappa) == {0, 1}
    for r in got:
        step = max(1.0, min(20.0, max(0.5, kappa[r.family]))) / 200
        assert r.n == 301 and r["values"] == pytest.approx([k * step for k in range(301)], abs=1e-6)


def test_trees_are_bundled(spark, sf):
    """a folder and a file a tree were written, 40 here."""
    shared = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.glob("trees-*"))
    got = files.src_trees(spark, sf)
    assert got.select("tree_id", "family").distinct().count() == 40 and got.count() == 40 * 30
    (made,) = set(shared.glob("trees-*")) - before
    assert 0 < data_files(made) < 20


def odd_cells(spark, families=(0, 1, None)):
    """Cells with null keys, null states and rows twice."""
    rows = [(f, s, p, None if (s or 0) * p % 7 == 3 else ((s or 9) * p + (f or 0)) % 20) for f in families for s in (4, 0, 2, None, 9) for p in range(70)]
    return spark.createDataFrame(rows + rows[:40], "family bigint, seq_id bigint, pos bigint, state int")


def test_replicates_made_in_place(spark, monkeypatch):
    """replicates, their planes, pairs and distances were each shuffled, 20 times the alignment."""
    cells = odd_cells(spark)
    few = pairs.few_sequences(cells)
    got = resample.bootstrap_cells(cells, 3)
    counts = pairs.pair_counts(got, 5, ("family", "rep"), in_place=few)
    assert few and counts._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    made, joined = sorted(map(str, got.collect())), sorted(map(str, pairs.pair_counts(got, 5, ("family", "rep")).collect()))
    assert sorted(map(str, counts.collect())) == joined and joined
    monkeypatch.setattr(resample, "HELD", 0)
    assert sorted(map(str, resample.bootstrap_cells(cells, 3).collect())) == made and made
    monkeypatch.setattr(resample, "HELD", 360)  # family 0 has 390 cells
    assert sorted(map(str, resample.bootstrap_cells(cells, 3).collect())) == made


def test_replicates_of_gapped_positions_raise(spark):
    cells = spark.createDataFrame([(0, s, p, 1) for s in (0, 1) for p in (0, 1, 3)], "family bigint, seq_id bigint, pos bigint, state int")
    with pytest.raises(Exception, match="without gaps"):
        resample.bootstrap_cells(cells, 2).collect()


def test_matrices_packed_at_once(spark):
    """distances were stored and shuffled before each matrix became a row."""
    rng = np.random.default_rng(8)
    rows = [(f, r, i, j, float(rng.random() + 0.1)) for f, n in ((0, 9), (1, 4), (2, 2)) for r in (0, 1) for i in range(n) for j in range(i + 1, n)]
    dist = spark.createDataFrame(rows, "family bigint, rep bigint, i bigint, j bigint, d double")
    assert sorted(map(str, trees.bionj(dist, few=True).collect())) == sorted(map(str, trees.bionj(dist).collect()))
    assert trees.bionj(dist.filter("d < 0"), few=True).collect() == []


def test_distances_made_in_place(spark):
    """codes of pairs, their lists and the eigen forms were shuffled, the lists three times. Null keys, no common sites or blocks."""
    cells = odd_cells(spark).distinct().filter("family is null or family = 0 or seq_id <> 4 or pos >= 66").filter(
        "family is null or family = 0 or seq_id <> 9 or pos < 60").withColumn("state", F.col("state") % 4)
    none = spark.createDataFrame([(5, 1, 0, None), (5, 2, 0, None)], cells.schema)
    cells = cells.unionByName(none).cache()
    families = spark.createDataFrame([(0,), (1,), (5,), (None,)], "family bigint")
    pi = families.select("family", F.explode(F.array(*map(F.lit, range(4)))).alias("state"), F.lit(0.25).alias("pi"))
    q = families.select("family", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(-1.0 if i == j else 1 / 3).alias("q"))
                                                     for i in range(4) for j in range(4)])))
    forms = [distance.eigen_forms(q, pi, ["family"], made=made).withColumn("model", F.lit("JC")) for made in (True, False)]
    n = distance.partitions_of(cells)
    assert n == 1 and distance.partitions_of(cells, chunk=5) is None
    want = distance.model_distance(cells, 4, forms[0], models=["model"])
    got = distance.model_distance(cells, 4, forms[1], models=["model"], partitions=n)
    rows, seen = sorted(map(str, want.collect())), sorted(map(str, got.collect()))
    assert seen == rows and any("lnl=None" in r for r in rows) and any("family=5" in r for r in rows)
    codes = distance.state_pairs(cells, 4, partitions=n)
    lists = codes.groupBy("family", "i", "j").agg(F.collect_list("code"))
    shuffles = [line for line in lists._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert "REPARTITION_BY_NUM" in shuffles[0]  # none after the alignments are dealt out
    assert sorted(map(str, codes.filter("code is not null").collect())) == sorted(map(str, distance.state_pairs(cells, 4).collect()))
