"""Operators for preparing and auditing LLM training data; nothing in the core imports this."""
