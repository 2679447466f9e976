"""Column expressions: parsing, cleaning and labels."""
