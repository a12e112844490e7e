"""Training-data operators: language, near-copies, tokens, quality, mixing, toxicity, repeats, media."""
