"""Named reports over the driver's tables."""


def _load():
    import importlib
    import pkgutil

    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_reports"):
            importlib.import_module(f"{__name__}.{module.name}")


def all_queries():
    from jobtrail.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_oracle_sql():
    from jobtrail.plans.registry import ORACLE

    _load()
    return dict(ORACLE)
