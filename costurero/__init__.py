"""Costurero: production-progress analytics for garment makers, as Spark DataFrame plans."""
