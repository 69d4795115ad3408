"""Relational, graph, text and ranking operators."""
