"""Relational operators of the take-off and costing dataflow."""
