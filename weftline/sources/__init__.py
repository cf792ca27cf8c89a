"""Sources of weftline."""
