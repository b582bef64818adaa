"""Training-data operators: near-duplicates, tokens, language, repeats, personal data, pages, quality, archives, shards, leaks.

Nothing else in the package imports this subpackage. Operators are plain functions from DataFrames to DataFrames;
``queries`` holds the thin registered queries.
"""
