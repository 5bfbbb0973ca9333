"""Column functions and window recipes over bytes and positions."""
