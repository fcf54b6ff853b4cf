"""Operators that prepare training text: duplicates, tokens, secrets, url rules, mixing, scoring and quality."""
