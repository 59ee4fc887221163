"""Training-data operators: packing, joins, mixing, scoring, deduplication, search, archives."""
