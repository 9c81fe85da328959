"""Operators on DataFrames: counts, features, gathers, groups, links, samples, rewrites."""
