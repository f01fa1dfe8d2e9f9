"""Multi-operator jobs: ingest, hybrid search, resurfacing, chat."""
