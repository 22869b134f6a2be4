"""Registered queries: the operators on the given tables, through adapters that make scenes of them."""
