"""A PySpark engine for document corpora: cleaning, chunking, retrieval and its bookkeeping."""
