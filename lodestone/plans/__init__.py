"""Builders of conditions and statements."""
