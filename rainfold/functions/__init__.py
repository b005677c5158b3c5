"""Monthly terms of the water balance as column expressions."""
