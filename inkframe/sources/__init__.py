"""Inputs, recognizer plug-ins and outputs."""
