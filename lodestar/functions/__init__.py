"""Column functions: links, families and array algebra."""
