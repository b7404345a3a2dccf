"""Reading and writing: listings, splits, vectors, scores, models, configurations, run records."""
