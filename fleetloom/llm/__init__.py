"""Operators on sequences and texts for training data; nothing else imports this."""
