"""Compositions: the text services, and the registered queries."""
