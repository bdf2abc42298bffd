"""Readers and writers of the file forms that corpora and reports come in."""
