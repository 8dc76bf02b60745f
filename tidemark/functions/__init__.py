"""Column expressions: pricing rules, thresholds and distribution functions."""
