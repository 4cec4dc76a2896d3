"""Column builders: random draws, parsing, masks, normal distribution."""
