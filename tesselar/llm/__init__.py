"""Operators for preparing training text: sharding, filtering, mixing, deduplication and tokenisation."""
