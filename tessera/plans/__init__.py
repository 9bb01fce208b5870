"""Registered queries: each operator applied to the tables of a scale factor."""
