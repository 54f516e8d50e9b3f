"""Column functions: everything here stays in Catalyst."""
