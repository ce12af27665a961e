"""Column expressions: text normalisation, dates, numbers, histograms, privileges."""
