"""Every operator bound to the driver's tables, next to an independent SQL statement."""
