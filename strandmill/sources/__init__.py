"""Readers and writers of the formats that token pipelines exchange."""
