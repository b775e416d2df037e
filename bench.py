"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

HEADLINE = [
    "fl_all_gap", "ag_patterns", "ag_codon_eqm", "ag_adj_aa", "jn_pairs", "jn_poisson", "jn_stability_branch",
    "tr_splits", "tr_greedy_trim", "tr_nj", "ps_score", "md_q_codon", "lnl_total", "rk_best", "bs_bootstrap",
]


#: Alignments (16 sequences, 120 sites) whose models are fitted, by data type, on their first tree.
FITTED = 16


def fit_times(spark, sf_dir: str) -> dict[str, float]:
    """Seconds of the fit of every model of a data type that needs no published matrix, in fast mode."""
    from aligngrid import catalog
    from aligngrid.plans import fixtures, ranking
    from aligngrid.plans.recoding import cleaned
    from aligngrid.session import cut

    codons = cut(cleaned(spark, sf_dir).filter(f"family < {FITTED}"))
    tree = cut(fixtures.edges(spark, sf_dir).filter(f"tree_id = 0 and family < {FITTED}").drop("tree_id"))
    given = {row[1] for row in catalog.model_rows() if row[2] != "AA" or row[1].startswith("EQU")}
    times = {}
    for kind in ("RY", "DNA", "AA", "CodonReduced"):
        models = [row[1] for row in catalog.model_rows() if row[2] == kind and row[1] in given]
        start = time.time()
        ranking.fit_models(codons, tree, models=models, rounds=ranking.ROUNDS["fast"])["fitted"].count()
        times[f"fit{FITTED}_{kind}"] = round(time.time() - start, 2)
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from aligngrid.plans import load
    from aligngrid.session import make_session

    shared = os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-")
    spark = make_session(cpus, memory=os.environ.get("BENCH_MEMORY", "16g"), shared=shared)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    queries["sc_is_gap"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 2)
    times |= fit_times(spark, sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 2), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
