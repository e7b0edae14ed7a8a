"""Plan shapes shared by the operators: staged tables, ordered totals, skew-proof joins."""
