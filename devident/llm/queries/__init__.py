"""One module per operator: the query NAME, the query, and its SQL or None."""
