"""Composed plans over the contest facts."""
