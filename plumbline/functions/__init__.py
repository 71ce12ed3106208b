"""functions of plumbline."""
