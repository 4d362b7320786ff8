"""Readers and writers of the zones, the dimensions and the documents."""
