"""Training-data operators: search, chat formatting, mixing, dedup, quality, language, secrets, tokens."""
