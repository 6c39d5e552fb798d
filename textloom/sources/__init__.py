"""Readers, writers and the adapters that bind the concepts of text analytics to tables."""
