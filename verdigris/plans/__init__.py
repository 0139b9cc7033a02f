"""Verdigris plans: registered queries, jobs and pipelines."""


def library():
    """The registry, with all query modules loaded."""
    from . import building, export, flows, lookups, registry, scoring, sizes, storage  # noqa: F401

    return registry
