"""Training-data operators: scoring, private data, near copies, repeated text, search, media, packing."""
