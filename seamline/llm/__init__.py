"""Training-data operators: token counts, media columns, classifiers, BPE, PII, archives, mixing, near-duplicates, search.

Nothing else in the library imports this package, so it can be removed without touching the rest.
"""
