"""Points to read, write and make, and tables of results."""
