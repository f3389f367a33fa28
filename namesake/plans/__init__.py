"""Stages built from the operators."""
