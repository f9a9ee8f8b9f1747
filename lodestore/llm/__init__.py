"""Training-data operators: deduplication, quality, tokens, licences, fingerprints, packing, language, mixing."""
