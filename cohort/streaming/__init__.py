"""Structured Streaming forms of scoring, pass-rate monitoring and de-duplication."""
