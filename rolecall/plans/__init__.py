"""Whole-pipeline plans: discovery, attribution, scoring, reports."""
