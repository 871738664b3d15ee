"""Column functions: dates, geometry, calibrated quantities, labels."""
