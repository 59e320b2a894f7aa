"""All registered queries and their SQL equivalents."""

from importlib import import_module

from duecourse.catalog import core

MODULES = ("base", "money", "quality", "checks", "profiles", "monitor", "files", "models")


def _load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")


def queries():
    _load()
    return dict(core.QUERIES)


def oracles():
    _load()
    return dict(core.ORACLES)
