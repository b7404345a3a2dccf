"""Column functions: text, vectors, hashes and scores."""
