"""Column expressions: state codes, hashes, distances, quartet classes, evidence."""
