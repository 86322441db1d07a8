"""Training-data operators: cleaning, selection, near-duplicates, mixing and archives of text corpora."""
