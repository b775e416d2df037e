"""Registered queries: trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from aligngrid.operators import trees as T
from aligngrid.plans import fixtures as X
from aligngrid.plans.pairing import aa_distances
from aligngrid.plans.recoding import rnd
from aligngrid.plans.registry import query
from oracle.common import r, with_


def side_text(c="side"):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("tr_unroot", with_("edges", """
select tree_id, family, node, case when node = moved then new_root else parent end parent,
 """ + r("case when node = moved then joined else length end") + """ length, leaf_seq from edges
join (select tree_id, family, sum(length) joined,
   arg_min(node, (leaf_seq is not null)::int * 1000000 + node) new_root,
   arg_max(node, (leaf_seq is not null)::int * 1000000 + node) moved from edges where parent = 0 group by 1, 2)
using (tree_id, family) where node <> new_root"""))
def tr_unroot(spark, sf):
    return T.unroot(X.edges(spark, sf)).withColumn("length", rnd(F.col("length")))


@query("tr_length", with_("edges", "select tree_id, family, " + r("sum(length)") + " tree_length from edges group by 1, 2"))
def tr_length(spark, sf):
    return T.tree_length(X.edges(spark, sf)).withColumn("tree_length", rnd(F.col("tree_length")))


@query("tr_splits", with_("splits", "select tree_id, family, node, array_to_string(side, ',') side from splits"))
def tr_splits(spark, sf):
    return T.splits(X.edges(spark, sf)).select("tree_id", "family", "node", side_text().alias("side"))


@query("tr_leaf_dist", with_("leafd", "select tree_id, family, i, j, " + r("d") + " d from leafd"))
def tr_leaf_dist(spark, sf):
    return T.leaf_distances(X.edges(spark, sf)).select("tree_id", "family", "i", "j", rnd(F.col("d")).alias("d"))


NODED = """
noded as (select a.tree_id, a.family, a.node i, b.node j, min(a.dist + b.dist) d, min(a.hops + b.hops) hops
 from clos a join clos b on a.tree_id = b.tree_id and a.family = b.family and a.anc = b.anc and a.node < b.node group by 1, 2, 3, 4)"""


@query("tr_node_dist", with_("clos", "select tree_id, family, i, j, " + r("d") + " d from noded", NODED))
def tr_node_dist(spark, sf):
    return T.node_distances(X.edges(spark, sf)).select("tree_id", "family", "i", "j", rnd(F.col("d")).alias("d"))


@query("tr_hops", with_("clos", """
select 'node' kind, tree_id, family, i, j, hops::bigint hops from noded
union all select 'branch', x.tree_id, x.family, x.node, y.node, min(coalesce(d.hops, 0))::bigint from
 (select tree_id, family, node, unnest([node, parent]) e from edges) x
 join (select tree_id, family, node, unnest([node, parent]) e from edges) y
  on x.tree_id = y.tree_id and x.family = y.family and x.node < y.node
 left join noded d on d.tree_id = x.tree_id and d.family = x.family and d.i = least(x.e, y.e) and d.j = greatest(x.e, y.e)
 group by 2, 3, 4, 5""", NODED))
def tr_hops(spark, sf):
    e = X.edges(spark, sf)
    nodes = T.node_distances(e).select("tree_id", "family", "i", "j", F.col("hops").cast("bigint").alias("hops"))
    branch = T.branch_hops(e, T.symmetric(nodes, T.all_nodes(e)))
    return nodes.withColumn("kind", F.lit("node")).unionByName(
        branch.select("tree_id", "family", F.col("b1").alias("i"), F.col("b2").alias("j"), "hops").withColumn("kind", F.lit("branch")))


@query("tr_within_depth", with_("clos", """
select tree_id, family, case when i = 1 then j else i end node, hops::bigint hops, hops = 3 at_depth from noded
where (i = 1 or j = 1) and hops <= 3 union all select distinct tree_id, family, 1, 0, false from edges""", NODED))
def tr_within_depth(spark, sf):
    e = X.edges(spark, sf)
    start = e.select("tree_id", "family").distinct().withColumn("node", F.lit(1))
    return T.walk(e, start, 3, up_to=True).withColumn("at_depth", F.col("hops") == 3)


@query("tr_prune", with_("clean clos", """
select c.tree_id, c.family, c.node, arg_min(anc, hops) parent, """ + r("min(dist)") + """ length, c.leaf_seq
from clos c join stay s on s.tree_id = c.tree_id and s.family = c.family and s.node = c.node
join stay p on p.tree_id = c.tree_id and p.family = c.family and p.node = c.anc
where hops > 0 group by 1, 2, 3, 6""", """
kl as (select e.* from edges e join kept on kept.family = e.family and kept.seq_id = e.leaf_seq),
live as (select distinct c.tree_id, c.family, c.anc node from kl join clos c using (tree_id, family, node)),
stay as (select tree_id, family, node from kl union all
  select tree_id, family, parent from edges join live using (tree_id, family, node) group by 1, 2, 3 having count(*) > 1)"""))
def tr_prune(spark, sf):
    from aligngrid.plans.recoding import fl_sparse

    keep = fl_sparse(spark, sf).withColumnRenamed("seq_id", "leaf_seq")
    return T.prune(X.edges(spark, sf), keep).withColumn("length", rnd(F.col("length")))


@query("tr_paint", with_("splits", """
select tree_id, family, node, ok is_clade, case when ok and (len([x for x in under if not list_contains(leaves, x)]) = 0
  or len([x for x in every if not list_contains(under, x) and not list_contains(leaves, x)]) = 0) then 7 else 0 end::int label
from un join ev using (tree_id, family) join (select family, under leaves from un where tree_id = 0 and node = 1) using (family)
join (select u.tree_id, u.family, bool_or(u.under = l.leaves or list_sort([x for x in every if not list_contains(u.under, x)]) = l.leaves) ok
 from un u join ev using (tree_id, family) join (select family, under leaves from un where tree_id = 0 and node = 1) l using (family) group by 1, 2)
 using (tree_id, family)"""))
def tr_paint(spark, sf):
    e = X.edges(spark, sf)
    clos = T.closure(e)
    # the clade below node 1 of the first tree, painted on both trees of the family
    clade = T.below(clos).filter("tree_id = 0 and node = 1").groupBy("family").agg(
        F.sort_array(F.collect_list("leaf_seq")).alias("leaves")).withColumn("label", F.lit(7))
    both = clade.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("tree_id"), "*")
    return T.paint(e, both, clos).select("tree_id", "family", "node", "is_clade", "label")


def tree_splits(spark, sf):
    """Marks of the splits keyed by one tree id, with leaf counts."""
    return T.split_marks(X.edges(spark, sf)).select(F.struct("tree_id", "family").alias("tree"), "side", "n_leaf")


@query("tr_rf", with_("splits", """
select a.tree_id, a.family, count(*) filter (b.family is null) rf from splits a
left join (select distinct tree_id, family, side from splits) b on b.tree_id = 1 - a.tree_id and b.family = a.family and b.side = a.side
group by 1, 2"""))
def tr_rf(spark, sf):
    return _rf_both_ways(spark, sf).select("a.tree_id", "a.family", "rf")


def _rf_both_ways(spark, sf):
    fam = X.family_sizes(spark, sf)
    pairs = fam.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("t"), "family").select(
        F.struct(F.col("t").alias("tree_id"), "family").alias("a"),
        F.struct((1 - F.col("t")).alias("tree_id"), "family").alias("b"))
    return T.rf(tree_splits(spark, sf), pairs)


@query("tr_same", with_("splits", """
select family, (select count(*) from splits a where a.family = f.family and a.tree_id = 0 and not exists
 (select 1 from splits b where b.family = a.family and b.tree_id = 1 and b.side = a.side)) = 0 same from fam f"""))
def tr_same(spark, sf):
    return _rf_both_ways(spark, sf).filter("a.tree_id = 0").select("a.family", (F.col("rf") == 0).alias("same"))


@query("tr_compatible", with_("splits clean", """
select l.family, count(m.side) missing, count(m.side) = 0 compatible from lv l left join
 (select s.family, s.side from s1 s where len(side) > 1 and len(every) - len(side) > 1 and not exists
   (select 1 from cutd d where d.family = s.family and d.side = s.side)) m using (family) group by 1""", """
kl1 as (select e.* from edges e join kept on kept.family = e.family and kept.seq_id = e.leaf_seq where e.tree_id = 1),
ev1 as (select family, list(leaf_seq order by leaf_seq) every from kl1 group by 1),
un1 as (select b.family, b.node, list(b.leaf_seq order by b.leaf_seq) under from below b
  join kl1 on kl1.family = b.family and kl1.leaf_seq = b.leaf_seq where b.tree_id = 1 and b.node <> 0 group by 1, 2),
s1 as (select distinct family, every, case when list_contains(under, every[1]) then under
  else [x for x in every if not list_contains(under, x)] end side from un1 join ev1 using (family)),
lv as (select family, every leaves from ev1),
cutd as (select distinct s.family, case when list_contains(s.side, leaves[1]) then [x for x in leaves if list_contains(s.side, x)]
  else [x for x in leaves if not list_contains(s.side, x)] end side from splits s join lv using (family) where s.tree_id = 0)"""))
def tr_compatible(spark, sf):
    from aligngrid.plans.recoding import fl_sparse

    e = X.edges(spark, sf)
    clos = T.closure(e)
    keep = fl_sparse(spark, sf).withColumnRenamed("seq_id", "leaf_seq")
    # second tree, sparse leaves cut away, against the whole first tree
    sub = T.prune(e.filter("tree_id = 1"), keep, clos.filter("tree_id = 1"))
    sub_splits = T.splits(sub).select("family", "side", "every").distinct()
    return T.compatible(sub_splits, T.splits(e, clos).filter("tree_id = 0").select("family", "side"))


def _greedy_sql(k):
    out = """full2 as (select tree_id, family, i, j, d from leafd union all select tree_id, family, j, i, d from leafd),
c0 as (select tree_id, family, arg_max(row(i, j, d), row(d, -i, -j)) z from leafd group by 1, 2),
ch0 as (select tree_id, family, unnest([z[1], z[2]]) leaf_seq, 0 "round" from c0),
r0 as (select c.tree_id, c.family, p.j x, (p.d + q.d - z[3]) / 2 att from c0 c
  join full2 p on p.tree_id = c.tree_id and p.family = c.family and p.i = z[1] and p.j <> z[2]
  join full2 q on q.tree_id = c.tree_id and q.family = c.family and q.i = z[2] and q.j = p.j)"""
    for n in range(1, k - 1):
        out += f""",
n{n} as (select tree_id, family, arg_max(x, row(round(att, 9), -x)) z from r{n - 1} group by 1, 2),
r{n} as (select r.tree_id, r.family, r.x, least(any_value(r.att), min((ax.d + zx.d - az.d) / 2)) att from r{n - 1} r
  join n{n} n on n.tree_id = r.tree_id and n.family = r.family and r.x <> n.z
  join ch{n - 1} c on c.tree_id = r.tree_id and c.family = r.family
  join full2 az on az.tree_id = r.tree_id and az.family = r.family and az.i = n.z and az.j = c.leaf_seq
  join full2 ax on ax.tree_id = r.tree_id and ax.family = r.family and ax.i = c.leaf_seq and ax.j = r.x
  join full2 zx on zx.tree_id = r.tree_id and zx.family = r.family and zx.i = n.z and zx.j = r.x group by 1, 2, 3),
ch{n} as (select * from ch{n - 1} union all select tree_id, family, z, {n} from n{n})"""
    return out


@query("tr_greedy_trim", with_("leafd", 'select tree_id, family, leaf_seq, "round" from ch4', _greedy_sql(6)))
def tr_greedy_trim(spark, sf):
    return T.greedy_trim(X.edges(spark, sf), 6)


def nj_sql(source, keys, leaves=16):
    """CTEs ending in nj(keys, node, parent, length, leaf_seq): BIONJ of `source` (keys, i, j, d), a merge a round, unrolled for
    `leaves` leaves. Inner nodes are numbered from the largest leaf id of all trees on."""
    k, on = ", ".join(keys), lambda a, b: " and ".join(f"{a}.{x} = {b}.{x}" for x in keys)
    of = lambda a: ", ".join(f"{a}.{x}" for x in keys)
    out = f"""
m0 as materialized (select {k}, i, j, d::double d, d::double v from {source}),
nd0 as materialized (select distinct {k}, c, c::bigint node from (select {k}, i c from m0 union all select {k}, j from m0)),
size as (select (select max(n) from (select count(*) n from nd0 group by {k})) top, (select max(c) from nd0) + 1 inn)"""
    for r_ in range(leaves - 3):
        out += f""",
lv{r_} as materialized (select {k}, count(*) r from nd{r_} group by {k} having count(*) > 3),
sm{r_} as materialized (select {of('x')}, c, sum(d) s from (select {k}, i c, d from m{r_} union all select {k}, j, d from m{r_}) x
  join lv{r_} l on {on('x', 'l')} group by {of('x')}, c),
be{r_} as materialized (select {k}, z[1] b, z[2] a, z[3] d, z[4] vab, z[7] r, 0.5 * (z[3] + (z[6] - z[5]) / (z[7] - 2)) la,
   z[3] - 0.5 * (z[3] + (z[6] - z[5]) / (z[7] - 2)) lb from (
  select {of('m')}, arg_min(row(m.i, m.j, m.d, m.v, p.s, q.s, r), row(round((r - 2) * m.d - p.s - q.s, 6), m.j, m.i)) z
  from m{r_} m join lv{r_} l on {on('m', 'l')} join sm{r_} p on {on('p', 'm')} and p.c = m.i join sm{r_} q on {on('q', 'm')} and q.c = m.j
  group by {of('m')})),
sd{r_} as materialized (select {of('m')}, case when m.i in (a, b) then m.j else m.i end x, a, b, vab, la, lb, r,
   max(m.d) filter (m.i = a or m.j = a) da, max(m.d) filter (m.i = b or m.j = b) db,
   max(m.v) filter (m.i = a or m.j = a) va, max(m.v) filter (m.i = b or m.j = b) vb
  from m{r_} m join be{r_} e on {on('m', 'e')} where (m.i in (a, b)) <> (m.j in (a, b)) group by all),
la{r_} as materialized (select {k}, case when any_value(vab) = 0 then 0.5
   else least(1.0, greatest(0.0, 0.5 + sum(vb - va) / (2 * (any_value(r) - 2) * any_value(vab)))) end lam from sd{r_} group by {k}),
m{r_ + 1} as materialized (select {of('m')}, m.i, m.j, m.d, m.v from m{r_} m left join be{r_} e on {on('m', 'e')}
   where e.a is null or not (m.i in (e.a, e.b) or m.j in (e.a, e.b))
  union all select {of('s')}, least(a, x), greatest(a, x), lam * (da - la) + (1 - lam) * (db - lb),
   lam * va + (1 - lam) * vb - lam * (1 - lam) * vab from sd{r_} s join la{r_} l on {on('s', 'l')}),
ed{r_} as materialized (select {of('n')}, node, (select inn from size) + {r_} parent, greatest(0.0, case when c = a then la else lb end) length
  from nd{r_} n join be{r_} e on {on('n', 'e')} where c in (a, b)),
nd{r_ + 1} as materialized (select {of('n')}, c, case when c = a then (select inn from size) + {r_} else node end node
  from nd{r_} n left join be{r_} e on {on('n', 'e')} where a is null or c <> b)"""
    end = leaves - 3
    return out.strip() + f""",
fin as (select *, sum(d) over (partition by {k}) every, count(*) over (partition by {k}) np from m{end}),
tip as (select {k}, c, every, np, sum(d) s from (select {k}, i c, d, every, np from fin union all select {k}, j, d, every, np from fin)
  group by {k}, c, every, np),
all_edges as (select {of('t')}, node, (select inn + greatest(0, top - 3) from size) parent,
   greatest(0.0, case when np = 1 then every / 2 else s - every / 2 end) length from tip t join nd{end} n on {on('t', 'n')} and t.c = n.c
  {' '.join(f'union all select {k}, node, parent, length from ed{r_}' for r_ in range(end))}),
nj as (select *, case when node < (select inn from size) then node end leaf_seq from all_edges)"""


@query("tr_nj", with_("aadist", "select family, node, parent, " + r("length") + " length, leaf_seq from nj", nj_sql("aad", ["family"])))
def tr_nj(spark, sf):
    return T.bionj(aa_distances(spark, sf)).withColumn("length", rnd(F.col("length")))
