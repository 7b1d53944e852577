"""Relational operators: generic listing, joins with preference, multiset differences, running states."""
