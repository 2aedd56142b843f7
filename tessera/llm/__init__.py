"""Training-data operators: ten corpus-scale building blocks and their queries.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
