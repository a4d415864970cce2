"""Operators for preparing training text: deduplication, decontamination, scoring, formatting, packing."""
