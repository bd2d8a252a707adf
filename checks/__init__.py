"""Inputs, queries and reference SQL with which the operators are checked."""
