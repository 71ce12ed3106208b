"""plans of plumbline."""
