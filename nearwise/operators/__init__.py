"""DataFrame operators: nearest neighbours, facets, embedding, extraction, comparison."""
