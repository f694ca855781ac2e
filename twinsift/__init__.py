"""twinsift: exact-duplicate detection and index analytics as Spark plans."""
