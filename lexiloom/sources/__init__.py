"""Readers and writers: files, page rows, labelled texts, tables."""
