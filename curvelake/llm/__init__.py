"""Training-data operators: tokens, packing, de-duplication, quality, language, links and search."""
