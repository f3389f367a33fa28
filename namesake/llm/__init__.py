"""Operators for preparing training text at scale: counting, mixing, scoring, packing, filtering, deduplication."""
