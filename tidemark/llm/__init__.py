"""Operators for training-data pipelines: language ID, quality, chat formatting, tokens, dedup, packing, archives, HTML."""
