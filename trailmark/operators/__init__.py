"""DataFrame operators: admission, chunking, indexes, retrieval, graph and state."""
