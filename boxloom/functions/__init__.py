"""Scalar functions: rounding, hash-seeded draws, colours, geometry predicates."""
