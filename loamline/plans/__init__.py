"""Registered queries, their input views and the matching SQL oracles."""
