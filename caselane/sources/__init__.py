"""Readers, writers and the views bound to test tables."""
