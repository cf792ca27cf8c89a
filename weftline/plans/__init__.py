"""Plans of weftline."""
