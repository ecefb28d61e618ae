"""One module per stage: each takes a table and returns small result tables."""
