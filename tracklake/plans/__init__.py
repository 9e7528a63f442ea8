"""Named workflows built from the operators."""
