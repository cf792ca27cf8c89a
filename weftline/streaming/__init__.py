"""Streaming of weftline."""
