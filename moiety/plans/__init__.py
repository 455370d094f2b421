"""Registered queries, their SQL, and the fixtures they run on."""
