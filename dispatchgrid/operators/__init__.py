"""Operators by kind; importing a module registers its queries."""

MODULES = ("evaluate", "aggregates", "joins", "windows", "scalars", "nearest", "scenarios", "graphs", "sets", "statistics", "robust", "routing", "modes", "assignments", "reports", "partition", "pooled", "helpers", "waves", "fans", "detours", "on_demand", "studies", "tables", "polygons", "formats", "hubs", "swaps", "trials")


def load() -> None:
    from importlib import import_module

    for name in MODULES:
        import_module(f"{__name__}.{name}")
