"""Column functions: identifiers and text, all evaluated in the JVM."""
