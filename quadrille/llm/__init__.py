"""Operators for preparing training text: filters, tokenizing, joins and sampling over documents."""
