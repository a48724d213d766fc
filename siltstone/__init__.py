"""siltstone: request-decision and code-search analytics expressed as Spark plans."""
