"""General DataFrame operators: matching, ordering, deltas, reshaping, grouped statistics."""
