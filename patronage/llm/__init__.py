"""Corpus preparation for language-model training: extraction, filters, deduplication, search, mixing, packing."""
