"""Readers: tables, source trees, archives and on-disk catalogs."""
