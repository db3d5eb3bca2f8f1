"""Operators for large text corpora: scoring, near copies, packing, extraction, media and secrets."""
