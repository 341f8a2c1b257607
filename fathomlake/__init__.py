"""Search-and-answer analytics as DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; nothing is collected except bounded, documented summaries.
"""
