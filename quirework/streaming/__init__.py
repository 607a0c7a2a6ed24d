"""Streams of pasted text: the batch import on every micro-batch."""
