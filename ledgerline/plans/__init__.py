"""Data models: named datasets, relationships between them, and dictionaries."""
