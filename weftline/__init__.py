"""weftline: relationship, lineage and evidence analytics as Spark DataFrames."""
