"""Column functions: text, dates, vectors, geography."""
