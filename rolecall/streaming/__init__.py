"""Structured Streaming jobs for state that grows with every scan."""
