"""Column expressions: hashes and vectors, tokens, evidence."""
