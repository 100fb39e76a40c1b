"""Registered queries: each a whole-table use of an operator, with SQL that gives the same rows."""
