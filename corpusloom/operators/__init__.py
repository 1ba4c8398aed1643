"""Operators on messages, graphs, retrieval, code and archives."""
