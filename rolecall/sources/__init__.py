"""Readers and writers: crawled payloads in, reports out."""
