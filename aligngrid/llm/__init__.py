"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

`load()` gives their queries and SQL, as `aligngrid.plans.load()` does for the rest.
"""


def load():
    import importlib

    queries, oracle = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"aligngrid.llm.{name}")
        queries |= module.QUERIES
        oracle |= getattr(module, "ORACLE", {})
    return queries, oracle


MODULES = ["mixing", "fingerprint", "pii", "toolcalls", "repetition", "pieces", "suffix_dedup", "hosts", "revisits",
           "minhash", "alignment", "token_files", "repair"]
