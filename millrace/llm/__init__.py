"""Training-data operators: counting, filtering, scoring, deduplicating, mixing and encoding text at scale.

Nothing outside this subpackage imports it; every operator takes and returns DataFrames.
"""
