"""Runnable jobs and the catalogue of registered queries."""
