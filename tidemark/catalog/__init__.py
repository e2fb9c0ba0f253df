"""Named queries over the test tables, each with its SQL counterpart."""


def load():
    """The registry with every query module imported."""
    from . import measure, proofs, records, registry, search, site, streams  # noqa: F401

    return registry
