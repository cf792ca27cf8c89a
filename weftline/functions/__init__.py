"""Functions of weftline."""
