"""A document-corpus analytics engine on PySpark DataFrames."""
