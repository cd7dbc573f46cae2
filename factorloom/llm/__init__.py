"""Training-data operators: fingerprints, quality, search, binary ids, scoring, dedup, mixing, tokenization.

Nothing outside this subpackage imports it. Every operator is a function from DataFrames to
DataFrames; ``queries.py`` binds them to the tables of a data folder.
"""
