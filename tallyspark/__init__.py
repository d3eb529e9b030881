"""Statement-ledger analytics as plain DataFrame transforms."""
