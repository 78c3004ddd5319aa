"""Structured Streaming jobs: parse, enrich, windowed counts, idempotent sinks."""
