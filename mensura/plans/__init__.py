"""Whole dataflows and the registered queries."""
