"""Registered queries over the engine's operators."""


def queries():
    from . import documents, language, media  # noqa: F401
    from .registry import QUERIES

    return dict(QUERIES)


def oracle_sql():
    from . import documents, language, media  # noqa: F401
    from .registry import ORACLE

    return dict(ORACLE)
