"""DataFrame operators: retrieval, tables, chunking, charts, layout, memory, verification, evaluation."""
