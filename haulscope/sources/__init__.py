"""Readers, writers and the table bundle."""
