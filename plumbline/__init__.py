"""plumbline: sensor-calibration and corpus analytics as PySpark DataFrame jobs."""
