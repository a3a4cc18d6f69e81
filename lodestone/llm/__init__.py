"""Training-data operators: cleaning, deduplication, mixing and tokenising of documents.

Nothing outside this folder imports it.
"""
