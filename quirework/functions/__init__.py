"""Column to Column functions: each is one Catalyst expression over citation fields."""
