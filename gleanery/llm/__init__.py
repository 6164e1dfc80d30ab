"""Operators of a training-data pipeline: fingerprints, language, near copies, repeats, media, URLs, mixing, sharding, BPE, quality."""
