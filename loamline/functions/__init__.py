"""Fields, fingerprints and hashes as Column expressions."""
