"""Structured Streaming jobs: the operators that need no row position."""
