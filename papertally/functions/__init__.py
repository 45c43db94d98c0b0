"""Column expressions. All run inside the JVM, except ``ratio`` (Arrow batches)."""
