"""Column functions: cleaning, folding, similarity."""
