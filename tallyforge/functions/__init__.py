"""functions of tallyforge."""
