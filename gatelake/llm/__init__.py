"""Training-data operators: extraction, quality, secrets, duplicates, licences, decontamination, tokens and archives."""
