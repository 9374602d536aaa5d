"""Column functions: ``Column -> Column``, no DataFrame in sight."""
