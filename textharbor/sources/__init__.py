"""Readers and writers: files, pages, judgments, index segments."""
