"""Operators for preparing training text at scale: dedup, scans, mixing, formatting, archives."""
