"""Scalar functions as Column expressions; all stay on the JVM."""
