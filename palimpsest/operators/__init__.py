"""Operators over tables of the memory model."""
