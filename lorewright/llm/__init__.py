"""Operators for preparing training text: filters, extraction, dedup, search, mixing, packing.

Nothing outside this subpackage imports it.
"""
