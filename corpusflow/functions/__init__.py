"""Column functions: text normalisation, tokens, scalars, citations."""
