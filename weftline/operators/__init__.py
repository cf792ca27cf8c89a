"""Operators of weftline."""
