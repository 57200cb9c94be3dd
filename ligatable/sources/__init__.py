"""Readers, writers and the table mapping used by the registered queries."""
