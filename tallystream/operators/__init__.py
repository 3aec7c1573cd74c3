"""Reducers: atoms of a stream to units (spells, periods, observations, edges)."""
