"""Column functions: text folding, dates, shares, evidence tests and cell text."""
