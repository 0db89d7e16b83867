"""Lodestone: document retrieval analytics as DataFrame operators."""
