"""Operators on tables of cells, series, networks and stations."""
