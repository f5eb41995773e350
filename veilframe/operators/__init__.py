"""DataFrame transforms over documents, spans, maps and names."""
