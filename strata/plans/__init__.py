"""Repositories of versioned objects, and the registered queries."""
