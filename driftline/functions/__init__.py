"""Window and scalar expressions used by all operators."""
