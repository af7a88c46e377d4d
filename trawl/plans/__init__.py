"""Compositions: search, answers, investigations, evaluation, export."""
