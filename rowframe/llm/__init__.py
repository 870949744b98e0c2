"""Training-data operators: search, deduplication, decontamination, redaction, formatting and models.

Nothing else in the library imports this package; it can be removed as a whole.
"""
