"""Column helpers: numbers, calendar, text."""
