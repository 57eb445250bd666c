"""Column functions (native) and Arrow functions."""
