"""Structured Streaming jobs; each shares its logic with the batch operator."""
