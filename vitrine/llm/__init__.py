"""Training-data operators: mixing, quality, decontamination, licences, language models, toxicity, dedup, token counts."""
