"""Named queries over the given tables."""


def _load():
    from stacklens.plans import compat_queries, learning_queries, model_queries, registry, source_queries, stream_queries  # noqa: F401
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_sql():
    return dict(_load().SQL)
