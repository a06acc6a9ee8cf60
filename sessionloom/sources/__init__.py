"""Readers and writers of session documents."""
