"""Readers and writers of documents, pages, knowledge files and catalogs."""
