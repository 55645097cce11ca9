"""Column expressions: missing-value rules, recodes, calendar parts, units."""
