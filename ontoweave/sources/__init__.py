"""Readers and writers of ontologies, alignments and delimited files."""
