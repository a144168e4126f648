"""Plan parts: filters, search, sorting and projection, as data that compiles to Column expressions."""
