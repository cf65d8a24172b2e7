"""Column-level functions: canonical JSON, identities, fixed-point and parsing rules."""
