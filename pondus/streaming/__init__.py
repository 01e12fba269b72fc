"""Structured Streaming: survey waves arriving as files, KPIs maintained incrementally."""
