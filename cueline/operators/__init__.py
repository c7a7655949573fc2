"""DataFrame operators: ordering, merging, joins, checks, scores."""
