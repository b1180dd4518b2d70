"""Column functions: everything here is a JVM expression, without Python workers."""
