"""finlattice: equity and fund research analytics on PySpark."""
