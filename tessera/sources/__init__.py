"""Readers of the tables; no reader infers a schema it could be told."""
