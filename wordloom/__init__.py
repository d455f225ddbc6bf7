"""wordloom: subword tokenization and text processing as Spark plans."""

__version__ = "0.1.0"
