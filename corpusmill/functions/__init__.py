"""Column functions: text cleaning, similarity, scores and prompts."""
