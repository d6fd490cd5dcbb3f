"""Column expressions: blanks, keys, numbers, dates, arithmetic and spreadsheet formulas."""
