"""Readers, writers, synthetic manifolds and the embedder hook."""
