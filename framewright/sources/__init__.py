"""Readers and writers of signals, annotations, parameters and feature records."""
