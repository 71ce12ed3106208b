"""sources of plumbline."""
