"""Query catalogue: the operators wired to the tables of a data folder."""
