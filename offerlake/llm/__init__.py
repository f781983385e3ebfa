"""Training-data operators: tokenising, quality, search, decontamination, near copies, PII, language, URLs, repeats, licences."""
