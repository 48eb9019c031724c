"""String collections, coordinates and grammar tables in and out."""
