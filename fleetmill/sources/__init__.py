"""Readers, flatteners and writers."""
