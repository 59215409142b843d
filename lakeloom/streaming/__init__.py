"""No operator of this library takes an unbounded input: repeated runs skip what is already there by a left_anti join."""
