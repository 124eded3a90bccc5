"""Column builders and the answer matcher."""
