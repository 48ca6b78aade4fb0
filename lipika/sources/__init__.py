"""Readers and writers of corpora and trained artefacts."""
