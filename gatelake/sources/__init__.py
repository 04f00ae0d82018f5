"""Readers of gate tables and the derivation of gate tables from star-schema tables."""
