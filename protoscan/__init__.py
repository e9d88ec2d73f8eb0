"""protoscan: guide-RNA target scoring as PySpark DataFrame jobs."""
