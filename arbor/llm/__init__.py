"""Training-data operators: dedup, tokenizers, quality, mixing, personal data, media and LM scoring."""
