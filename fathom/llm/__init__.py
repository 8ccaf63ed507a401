"""Training-data operators: dedup, packing, mixing, token output, filters, chat formatting, search."""
