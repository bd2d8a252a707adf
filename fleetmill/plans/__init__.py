"""Whole jobs: compositions of operators that read a catalog and give its next state."""
