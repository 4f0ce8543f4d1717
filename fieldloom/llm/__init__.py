"""Operators for large text corpora: near-duplicates, mixing, licences, quality, decontamination,
personal data, token counts, repeated passages, media columns and web archives.

Nothing outside this subpackage imports it.
"""
