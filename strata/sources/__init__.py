"""Readers and writers: CSV tables, dataset files, directories, generated tables."""
