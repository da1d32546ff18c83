"""marlstone: a corpus ingest, retrieval and analytics engine on PySpark DataFrames."""
