"""operators of tallyforge."""
