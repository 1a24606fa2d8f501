"""Training-data operators: extraction, dedup, decontamination, tokens, quality and safety."""
