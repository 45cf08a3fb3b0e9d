"""The catalogue: one query per operator, with an SQL twin where SQL can express it."""
