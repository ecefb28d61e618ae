"""Column expressions and exact statistics the operators are made of."""
