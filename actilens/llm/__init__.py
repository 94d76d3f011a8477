"""Training-data operators: fingerprints, decontamination, token files, language and quality models, mixing, language-model
scores, duplicate spans. Nothing else in the library imports this package."""
