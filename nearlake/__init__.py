"""Nearest-neighbour analytics over dense embeddings, expressed as Spark plans."""
