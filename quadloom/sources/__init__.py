"""Where patterns are answered from, and readers and writers of RDF."""
