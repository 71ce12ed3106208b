"""operators of plumbline."""
