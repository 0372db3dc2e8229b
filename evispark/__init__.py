"""Evidence analytics on Spark: ingest, retrieval, extraction, merging, validation and comparison of evidence tables."""
