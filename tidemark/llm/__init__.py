"""Operators for training-text pipelines: dedup, decontamination, secrets, language, quality, BPE, PII, URLs, LM scores."""
