"""Find, resolve, replace and score personal data in text tables and streams on Spark."""
