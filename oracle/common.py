"""DuckDB side of the derived tables. `with_(...)` assembles a query with the CTEs it names."""

from __future__ import annotations

from aligngrid import catalog

SITES = """
w as (select doc_id, string_split(text, ' ') ws, len(string_split(text, ' ')) n from documents),
hc as (select doc_id // 16 family, doc_id % 16 seq_id, c,
         case when (c + 1) * n // 40 > c * n // 40
              then ('0x' || substr(md5(array_to_string(ws[c * n // 40 + 1 : (c + 1) * n // 40], ' ')), 1, 8))::bigint end o
       from w cross join (select unnest(range(0, 40)) c)),
cod3 as (select x.family, x.seq_id, x.c, x.o, coalesce(l.o, 0) a, k
         from hc x join hc l on l.family = x.family and l.c = x.c and l.seq_id = 0
         cross join (select unnest(range(0, 3)) k)),
sites as (select family, seq_id, c * 3 + k pos,
    case when o is null or o % 101 < 5 then '-'
         when (o // 3 + k * 31) % 997 = 0 then 'N'
         else substr('ACGT', 1 + ((a // (4 ** k)::bigint
              + case when (o // (1000 ** k)::bigint) % 1000 < 120
                     then 1 + (o // (1000 ** k)::bigint) % 1000 % 3 else 0 end) % 4)::int, 1) end ch
    from cod3)"""

SEQS = """
seqs as (select family, seq_id, string_agg(ch, '' order by pos) seq from sites group by 1, 2)"""

EDGES = """
fam as (select doc_id // 16 family, count(*) n from documents group by 1),
edges as (select t tree_id, family, node, (node - 1) // 2 parent,
            ((node * 37 + family * 11) % 90 + 10) / 1000.0::double "length",
            case when node >= n - 1 then (node - (n - 1) + 2 * t) % n end leaf_seq, n
          from (select family, n, unnest(range(1, 2 * n - 1)) node from fam)
          cross join (select unnest(range(0, 2)) t))"""


def code_cte(codes=(0,)) -> str:
    rows = []
    for code in codes:
        s = 0
        for c, codon, idx, aa, ch in catalog.code_rows([code]):
            rows.append(
                f"({c},'{codon}',{idx},{'NULL' if aa is None else aa},"
                f"{'NULL' if ch is None else repr(ch)},{'NULL' if aa is None else s})"
            )
            s += aa is not None
    return f"\ngcode as (select * from (values {','.join(rows)}) t(code, codon, codon_idx, aa, aa_ch, sense))"


# Codons of the raw text, then the cleaned ones ('---' unless three bases and no stop).
CODONS = """
codons as (select family, seq_id, pos // 3 cpos, string_agg(ch, '' order by pos) codon from sites group by 1, 2, 3)"""
CLEAN = """
cleaned as (select family, seq_id, cpos, case when aa is null then '---' else codons.codon end codon,
              aa, aa_ch, sense from codons left join gcode on gcode.codon = codons.codon and code = 0),
csites as (select family, seq_id, cpos * 3 + k pos, substr(codon, k + 1, 1) ch
           from cleaned cross join (select unnest(range(0, 3)) k)),
kept as (select family, seq_id from csites group by 1, 2
         having sum((ch <> '-')::int) >= 0.15 * count(*)),
ksites as (select csites.* from csites join kept using (family, seq_id)),
kcodons as (select cleaned.* from cleaned join kept using (family, seq_id))"""
PATTERNS = """
cols as (select family, pos, string_agg(ch, '' order by seq_id) pattern from ksites group by 1, 2),
patterns as (select family, pattern, count(*) n from cols group by 1, 2)"""

CLOS = """
nodes as (select tree_id, family, node, leaf_seq from edges union all select distinct tree_id, family, 0, null::bigint from edges),
clos as (select tree_id, family, node, node anc, 0 hops, 0.0::double dist, leaf_seq from nodes
  union all select c.tree_id, c.family, c.node, e.parent, c.hops + 1, c.dist + e.length, c.leaf_seq
  from clos c join edges e on e.tree_id = c.tree_id and e.family = c.family and e.node = c.anc),
below as (select tree_id, family, anc node, leaf_seq, hops, dist from clos where leaf_seq is not null)"""
SPLITS = """
ev as (select tree_id, family, list(leaf_seq order by leaf_seq) every from edges where leaf_seq is not null group by 1, 2),
un as (select tree_id, family, node, list(leaf_seq order by leaf_seq) under from below where node <> 0 group by 1, 2, 3),
splits as (select tree_id, family, node, every, case when list_contains(under, every[1]) then under
   else [x for x in every if not list_contains(under, x)] end side from un join ev using (tree_id, family))"""
LEAFD = """
leafd as (select a.tree_id, a.family, a.leaf_seq i, b.leaf_seq j, min(a.dist + b.dist) d, min(a.hops + b.hops) hops
  from below a join below b on a.tree_id = b.tree_id and a.family = b.family and a.node = b.node and a.leaf_seq < b.leaf_seq
  group by 1, 2, 3, 4)"""
# Pair counts by direct comparison of cells.
PAIRS = """
pairs as (select a.family, a.seq_id i, b.seq_id j, count(*) n_sites,
   count(*) filter (a.ch <> '-' and b.ch <> '-') n_both,
   count(*) filter (a.ch <> '-' and b.ch <> '-' and a.ch <> b.ch) n_diff,
   count(*) filter ((a.ch = '-') <> (b.ch = '-')) n_gap_diff,
   count(*) filter (least(a.ch, b.ch) || greatest(a.ch, b.ch) in ('AG', 'CT')) n_ts
  from ksites a join ksites b on a.family = b.family and a.pos = b.pos and a.seq_id < b.seq_id group by 1, 2, 3)"""
AADIST = """
aap as (select a.family, a.seq_id i, b.seq_id j, count(a.aa + b.aa) n, count(*) filter (a.aa <> b.aa) nd
  from kcodons a join kcodons b on a.family = b.family and a.cpos = b.cpos and a.seq_id < b.seq_id group by 1, 2, 3),
aad as (select family, i, j, n, nd, case when n = 0 or 1 - nd / n / 0.95 <= 0 then 20.0
   else greatest(0, -0.95 * ln(1 - nd / n / 0.95)) end d from aap)"""

PARTS = {"clos": CLOS, "splits": SPLITS, "leafd": LEAFD, "pairs": PAIRS, "aadist": AADIST, "sites": SITES, "seqs": SEQS, "edges": EDGES, "code": code_cte(), "codes": code_cte(range(12)),
         "codons": CODONS, "clean": CLEAN, "patterns": PATTERNS}
NEEDS = {"clos": ["edges"], "splits": ["clos"], "leafd": ["clos"], "pairs": ["clean"], "aadist": ["clean"],
         "seqs": ["sites"], "codons": ["sites"], "clean": ["codons", "code"], "patterns": ["clean"]}


def with_(parts: str, body: str, extra: str = "") -> str:
    """`parts`: space separated names; what they need is added in front."""
    order: list[str] = []

    def add(p):
        for q in NEEDS.get(p, []):
            add(q)
        if p not in order:
            order.append(p)

    for p in parts.split():
        add(p)
    ctes = [PARTS[p].strip() for p in order] + ([extra.strip().rstrip(",")] if extra else [])
    return ("with recursive " + ",\n".join(ctes) + "\n" if ctes else "") + body


def r(expr: str, places: int = 6) -> str:
    return f"round(({expr})::double + 1e-{places + 4}::double, {places}) + 0.0"
