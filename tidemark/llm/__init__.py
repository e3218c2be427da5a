"""Training-data operators: packing, filtering, scoring, search and deduplication of text corpora.

Nothing else in the library imports this subpackage; ``queries.py`` lists its queries.
"""
