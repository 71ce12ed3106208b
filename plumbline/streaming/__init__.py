"""streaming of plumbline."""
