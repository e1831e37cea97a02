"""Column expressions: probability tails, sequence text, axis scales, labels."""
