"""Reading predicates and choosing the files they need."""
