"""Operators for training-data pipelines: archives, quality, duplicates, toxicity, contamination,
secrets, neighbours, licences, packing and token files. Nothing else in the library imports this."""
