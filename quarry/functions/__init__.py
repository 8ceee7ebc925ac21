"""Column functions: text normalising and similarity, record shaping, vectors."""
