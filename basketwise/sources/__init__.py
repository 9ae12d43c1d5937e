"""Readers: table folders, databases, CSV extracts, model views and artefacts."""
