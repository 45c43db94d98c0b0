"""Whole-run compositions of the operators, their configuration and plugins."""
