"""Column functions: time, sun, numbers, coordinates, counter-based draws."""
