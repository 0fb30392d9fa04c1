"""Readers and writers of hypergraph, partition and graph files."""
