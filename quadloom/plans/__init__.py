"""Query text to algebra, and rewrites of the algebra."""
