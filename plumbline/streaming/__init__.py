"""Column statistics of a stream, kept as sums that merge."""
