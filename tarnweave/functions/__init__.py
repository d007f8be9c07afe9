"""Column expressions: text, addresses, HTML, chunking, classification."""
