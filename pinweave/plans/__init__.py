"""Registered queries and the end-to-end partition plan."""
