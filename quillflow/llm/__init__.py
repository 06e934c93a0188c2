"""Operators for text corpora: deduplication, tokens, quality, chat, packing, secrets, language models."""
