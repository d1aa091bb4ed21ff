"""Column expressions and the few Arrow functions that need Python."""
