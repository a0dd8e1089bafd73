"""Relational operators of matching: blocking, joins, graphs, selection, evaluation and corpora."""
