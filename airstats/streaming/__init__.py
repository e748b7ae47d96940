"""Structured Streaming: incremental loading and scoring."""
