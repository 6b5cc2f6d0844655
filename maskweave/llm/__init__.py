"""Training-data operators (PII, near duplicates, packing, quality, ...). Nothing outside imports it."""
