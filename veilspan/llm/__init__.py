"""Training-data operators: ten document operators and their registered queries.

Nothing outside this subpackage imports it.
"""
