"""Plans made of the operators."""
