"""Training-data operators: tokens, packing, duplicates, toxicity, personal data, licences, vectors, media."""
