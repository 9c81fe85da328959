"""Column functions: text transforms, predicates, counts, hashed draws."""
