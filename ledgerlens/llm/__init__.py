"""Training-data operators: deduplication, decontamination, scoring, mixing and formatting of documents."""
