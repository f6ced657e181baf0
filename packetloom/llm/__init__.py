"""Operators for preparing training corpora: mixing, scans, de-duplication, search, language, token files, packing."""
