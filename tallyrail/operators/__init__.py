"""DataFrame operators: selection, metrics and reports, audits, differences, retrieval, caches, validation."""
