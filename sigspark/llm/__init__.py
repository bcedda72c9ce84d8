"""Operators for preparing training data: decontamination, privacy, quality, duplicates, tokens, languages, licences, toxicity."""
