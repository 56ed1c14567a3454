"""Operators for large training corpora: search, scoring, sharding, joins, packing, filtering, archives, mixing, chat."""
