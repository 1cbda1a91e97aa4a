"""DataFrame operators: library, people, retrieval, ingest."""
