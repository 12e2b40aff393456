"""Column functions that plans and operators share."""
