"""Operators of a training-data pipeline: packing, tokens, fingerprints, toxicity, secrets, archives, licences, duplicates, quality."""
