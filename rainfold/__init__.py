"""Rainfold: monthly basin water balances on Spark tables of grid cells."""
