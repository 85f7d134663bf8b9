"""Structured Streaming fronts of the incremental operators."""
