"""sources of tallyforge."""
