"""Streaming forms: file pick-up by hash, and the audit sink."""
