"""Electrical networks: sensitivities, outages and their graph."""
