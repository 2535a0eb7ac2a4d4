"""Operators for preparing training data: dedup, quality, language, tokens, packing, chat."""
