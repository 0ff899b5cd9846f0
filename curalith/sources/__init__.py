"""Readers and writers of scripts, logs, manifests, audio and reports."""
