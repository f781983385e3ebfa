"""Column functions on text, dates and facts."""
