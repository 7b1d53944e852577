"""Column functions: calendar, numbers, text."""
