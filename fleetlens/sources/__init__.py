"""Readers of logs, dumps and documents, and writers of their results."""
