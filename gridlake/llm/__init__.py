"""Operators for text corpora and large-scale data preparation; nothing else imports this package."""
