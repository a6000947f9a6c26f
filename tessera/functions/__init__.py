"""Column builders: pure expressions that Catalyst compiles; no data is touched here."""
