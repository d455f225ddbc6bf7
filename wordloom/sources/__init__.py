"""Readers of tokenizer definitions and tables."""
