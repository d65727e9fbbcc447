"""Proofs from query plans."""
