"""Column functions (JVM side) and the few Arrow-batched Python functions."""
