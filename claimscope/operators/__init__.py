"""DataFrame -> DataFrame operators: claims, cleanup, reports, windows,
reshape, graph, features, models, metrics, explanation."""
