"""Session indexing and search, and operators for large text corpora, on Spark."""
