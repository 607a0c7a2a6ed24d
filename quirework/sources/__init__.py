"""Readers: saved posts, pasted text, BibTeX, form rows, and metadata looked up by identifier."""
