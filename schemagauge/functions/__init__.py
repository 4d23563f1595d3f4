"""Column functions over ``VARIANT`` values."""
