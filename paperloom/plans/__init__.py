"""Whole plans: rendering test pages, extracting records, evaluation, the registered queries."""
