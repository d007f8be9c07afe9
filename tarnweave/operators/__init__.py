"""DataFrame operators: deduplication, merging, profiles, graphs, vectors, look-ups, layout, audits."""
