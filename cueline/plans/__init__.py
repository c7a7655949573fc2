"""Compositions of operators: jobs, derived inputs and registered queries."""
