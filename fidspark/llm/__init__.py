"""Training-data operators: cleaning, deduplication, mixing, packing, archives.

Each module is one operator; ``queries`` holds the registered queries. Nothing
else in the library imports this package.
"""
