"""Column functions (JVM side) and the few Arrow functions that no built-in can express."""
