"""Structured Streaming: feeds and reactions."""
