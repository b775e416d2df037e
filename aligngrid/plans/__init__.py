def load():
    """Import every query module and return (queries, oracle SQL)."""
    import importlib

    from aligngrid.plans import registry

    for name in ("recoding", "counting", "pairing", "treework", "modelling", "scoring", "files"):
        importlib.import_module(f"aligngrid.plans.{name}")
    return registry.QUERIES, registry.ORACLE
