"""Plan shapes shared by the operators: bounded windows, block prefixes, skew-safe joins, checkpoints."""
