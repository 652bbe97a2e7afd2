"""Training-data operators: ten corpus-scale jobs, each in a module of its own.

Nothing outside this subpackage imports it; the entry module adds its queries
only when the subpackage is present.
"""
