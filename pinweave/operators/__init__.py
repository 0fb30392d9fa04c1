"""Relational operators over hypergraphs, partitions and graphs."""
