"""DataFrame operators: retrieval, ranking, metrics, resolution, graphs, sampling, checks."""
