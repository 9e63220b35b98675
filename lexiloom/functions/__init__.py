"""Column functions: text cleaning, segmentation, tokens, rounding."""
