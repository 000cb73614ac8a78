"""Readers and writers: inventory documents, archives' tables of contents, metadata files, hash files."""
