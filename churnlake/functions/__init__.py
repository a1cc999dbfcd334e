"""Column builders: everything here returns ``Column`` expressions and runs no job."""
