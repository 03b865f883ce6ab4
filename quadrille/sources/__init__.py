"""Point tables: from the driver's tables, and generated ones."""
