"""Ledger operators: each is a DataFrame-to-DataFrame transform over all users at once."""
