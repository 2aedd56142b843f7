"""Structured Streaming variants (an extension, not a parity claim)."""
