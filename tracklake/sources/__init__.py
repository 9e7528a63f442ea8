"""Readers and writers of media bytes."""
