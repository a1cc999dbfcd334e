"""Readers and writers for customer data."""
