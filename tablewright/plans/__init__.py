"""Query plans: what is asked (QuerySpec), where it is (SchemaPlan), their binding, and its DataFrame."""
