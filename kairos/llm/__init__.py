"""Training-data operators: dedup, filtering, scoring, mixing and encoding of documents."""
